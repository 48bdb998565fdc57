"""Regressions: least squares from moments, batches of logistic fits by Newton passes, Cox with Efron ties."""

from __future__ import annotations

import dataclasses
import math

import numpy as np

from dagwright.functions.distributions import chi2_upper, f_upper, normal_two_sided, t_two_sided


@dataclasses.dataclass
class Fit:
    coef: np.ndarray
    se: np.ndarray
    p: np.ndarray
    rss: float = math.nan
    r2: float = math.nan
    loglik: float = math.nan


def ols(gram: np.ndarray, n: int, y: int, xs: list[int]) -> Fit:
    """Least squares of design column y on an intercept and columns xs, from the moments of [1, design]."""
    cols = [0, *(x + 1 for x in xs)]
    if n <= len(cols):
        raise ValueError("fewer rows than coefficients")
    a, b, yy = gram[np.ix_(cols, cols)], gram[cols, y + 1], gram[y + 1, y + 1]
    inv = np.linalg.inv(a)
    if not np.isfinite(inv).all() or np.linalg.cond(a / np.sqrt(np.outer(np.diag(a), np.diag(a)))) > 1e13:
        raise np.linalg.LinAlgError("singular design")
    coef = inv @ b
    rss = max(float(yy - coef @ b), 0.0)
    tss = float(yy - gram[0, y + 1] ** 2 / n)
    df = n - len(cols)
    se = np.sqrt(np.maximum(np.diag(inv) * rss / df, 0))
    se[se == 0] = 1e-10
    p = np.array([t_two_sided(t, df) for t in coef / se])
    return Fit(coef, se, p, rss, 1 - rss / tss if tss > 0 else math.nan, -n / 2 * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1))


def nested_f(gram: np.ndarray, n: int, y: int, tested: list[int], given: list[int]) -> tuple[float, float]:
    """F statistic and p of leaving `tested` out of the least-squares fit."""
    full, less = ols(gram, n, y, [*tested, *given]), ols(gram, n, y, given)
    d1, d2 = len(tested), n - 1 - len(tested) - len(given)
    f = max((less.rss - full.rss) / d1 / max(full.rss / d2, 1e-300), 1e-15)
    return f, f_upper(f, d1, d2)


def logistic_batch(data, tasks: list[tuple[int, list[int]]], most: int = 100) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Binary logits (target design column, regressor columns), each with an intercept; one pass a Newton step for all.

    Columns are centred and scaled within the fit. Returns coefficients and covariance, None where a fit
    does not settle or is not finite.
    """
    g, n = data.gram(), data.n
    mean = g[0, 1:] / n
    sd = np.sqrt(np.maximum(np.diag(g)[1:] / n - mean**2, 1e-300))
    out: list = [None] * len(tasks)
    groups: dict[int, list[int]] = {}
    for i, (_, cols) in enumerate(tasks):
        groups.setdefault(len(cols), []).append(i)
    ys = {k: np.array([tasks[i][0] for i in own]) for k, own in groups.items()}
    xs = {k: np.array([tasks[i][1] for i in own], int).reshape(len(own), k) for k, own in groups.items()}
    betas, before = {}, {}
    for k, own in groups.items():
        rate = np.clip(mean[ys[k]], 1e-6, 1 - 1e-6)
        betas[k] = np.zeros((len(own), k + 1))
        betas[k][:, 0] = np.log(rate / (1 - rate))
        before[k] = np.full(len(own), np.nan)
    active = {k: np.arange(len(own)) for k, own in groups.items()}
    for _ in range(most):
        active = {k: a for k, a in active.items() if len(a)}
        if not active:
            break
        now = [(k, ys[k][a], xs[k][a], betas[k][a]) for k, a in active.items()]

        def passed(x, now=now):
            return np.concatenate([newton_sums(x, y, cols, b, mean, sd).sum(axis=0).ravel() for _, y, cols, b in now])

        got, at = data.sum_rows(passed, sum(len(a) * (1 + (k + 1) + (k + 1) ** 2) for k, a in active.items())), 0
        for k, a in list(active.items()):
            w = 1 + (k + 1) + (k + 1) ** 2
            own, at = got[at : at + len(a) * w].reshape(len(a), w), at + len(a) * w
            ll, grad, hess = own[:, 0], own[:, 1 : k + 2], own[:, k + 2 :].reshape(-1, k + 1, k + 1)
            fine = np.isfinite(own).all(axis=1)
            hess = np.where(fine[:, None, None], hess, np.eye(k + 1)) + 1e-12 * np.eye(k + 1)
            fine &= np.linalg.cond(hess) < 1e15
            cov = np.linalg.inv(np.where(fine[:, None, None], hess, np.eye(k + 1)))
            done = fine & (np.abs(ll - before[k][a]) <= 1e-7)
            for j in np.flatnonzero(done):
                i, b = groups[k][a[j]], betas[k][a[j]]
                scale = np.concatenate(([1.0], 1 / sd[tasks[i][1]]))
                back = np.diag(scale)
                back[0, 1:] = -mean[tasks[i][1]] * scale[1:]
                if np.isfinite(b).all() and np.abs(b).max() < 1e3:
                    out[i] = back @ b, back @ cov[j] @ back.T
            before[k][a] = ll
            step = np.einsum("tij,tj->ti", cov, np.where(fine[:, None], grad, 0))
            betas[k][a] += step * np.minimum(1.0, 10 / np.maximum(np.abs(step).max(axis=1), 1e-12))[:, None]
            active[k] = a[fine & ~done & np.isfinite(betas[k][a]).all(axis=1)]
    return out


def newton_sums(x: np.ndarray, y: np.ndarray, cols: np.ndarray, b: np.ndarray, mean: np.ndarray, sd: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """[block, task, 1 + k + k * k]: log-likelihood, gradient and information of logits with as many columns each, block by block of rows."""
    t, k = cols.shape
    rows = max(1, cells // max(1, t * (k + 1)))
    out = np.zeros((-(-len(x) // rows), t, 1 + (k + 1) + (k + 1) ** 2))
    for i in range(len(out)):
        part = x[i * rows : (i + 1) * rows]
        z = np.ones((t, len(part), k + 1))
        if k:
            z[:, :, 1:] = ((part[:, cols] - mean[cols]) / sd[cols]).transpose(1, 0, 2)
        eta = np.clip(np.einsum("tnk,tk->tn", z, b), -30, 30)
        p, target = 1 / (1 + np.exp(-eta)), part[:, y].T
        out[i, :, 0] = (target * eta - np.logaddexp(0, eta)).sum(axis=1)
        out[i, :, 1 : k + 2] = np.einsum("tnk,tn->tk", z, target - p)
        out[i, :, k + 2 :] = (z.transpose(0, 2, 1) @ (z * (p * (1 - p))[:, :, None])).reshape(t, -1)
    return out


def multinomial_loglik(data, targets: list[tuple[list[int], list[list[int]], list[np.ndarray]]]) -> np.ndarray:
    """Log-likelihoods of softmax models [0, X b1, X b2, ...] put together from binary fits of each level against the rest."""

    def passed(x):
        out = []
        for ys, cols, coefs in targets:
            eta = np.zeros((len(x), len(ys) + 1))
            for k, (c, b) in enumerate(zip(cols, coefs, strict=True)):
                eta[:, k + 1] = b[0] + x[:, c] @ b[1:]
            top = eta.max(axis=1)
            y = x[:, ys]
            picked = (eta[:, 1:] * y).sum(axis=1)
            out.append(float((picked - top - np.log(np.exp(eta - top[:, None]).sum(axis=1))).sum()))
        return np.array(out)

    return data.sum_rows(passed, len(targets)) if targets else np.zeros(0)


def likelihood_ratio(full: float, less: float, df: int) -> tuple[float, float]:
    x = max(2 * (full - less), 1e-15)
    return x, chi2_upper(x, df)


def strata_cuts(strata: np.ndarray) -> np.ndarray:
    """Where runs of one stratum start, and the end."""
    return np.concatenate(([0], np.flatnonzero(np.diff(strata)) + 1, [len(strata)]))


def running(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cumulative sums along the first axis, from nothing again at each cut."""
    out = np.empty_like(v)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        np.cumsum(v[a:b], axis=0, out=out[a:b])
    return out


def cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, most: int = 100, strata: np.ndarray | None = None) -> Fit:
    """Proportional hazards by Newton steps on the partial likelihood with Efron's correction of ties.

    Risk sets hold rows of one stratum.
    """
    strata = np.zeros(len(time)) if strata is None else strata
    order = np.lexsort((-event, -time, strata))
    time, event, x, strata = time[order], event[order], x[order], strata[order]
    cuts = strata_cuts(strata)
    k = x.shape[1]
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1)
    z = (x - mean) / sd
    # risk sets, times from the largest down, end where a time does; its events stand first among its rows
    ends = np.append(np.flatnonzero((np.diff(time) != 0) | (np.diff(strata) != 0)), len(time) - 1)
    firsts = np.append(0, ends[:-1] + 1)
    ties = np.add.reduceat(event, firsts).astype(int)
    # one row for each event: where its risk set ends, which time it has, and Efron's share of the tied events
    which = np.repeat(np.arange(len(ends)), ties)
    share = (np.arange(len(which)) - np.repeat(np.cumsum(ties) - ties, ties)) / np.maximum(ties[which], 1)
    end, died = ends[which], event > 0

    def at(b):
        w = np.exp(np.clip(z @ b, -500, 500))
        wz = w[:, None] * z
        wzz = wz[:, :, None] * z[:, None, :]
        sums = [running(v, cuts)[end] - share.reshape(-1, *[1] * (v.ndim - 1)) * np.add.reduceat(np.where(died.reshape(-1, *[1] * (v.ndim - 1)), v, 0), firsts, axis=0)[which] for v in (w, wz, wzz)]
        r0, r1, r2 = sums
        r1 = r1 / r0[:, None]
        ll = float((z[died] @ b).sum() - np.log(r0).sum())
        return ll, z[died].sum(axis=0) - r1.sum(axis=0), (r2 / r0[:, None, None]).sum(axis=0) - r1.T @ r1

    b, last = np.zeros(k), None
    for _ in range(most):
        ll, grad, hess = at(b)
        if last is not None and abs(ll - last) <= 1e-9 * max(1.0, abs(ll)):
            break
        if k == 0:
            break
        last = ll
        step = np.linalg.solve(hess, grad)
        b = b + step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-12))
    else:
        raise ValueError("no convergence")
    cov = np.linalg.inv(hess) if k else np.zeros((0, 0))
    se = np.sqrt(np.diag(cov))
    if not np.isfinite(se).all():
        raise ValueError("no finite fit")
    return Fit(b / sd, se / sd, np.array([normal_two_sided(v) for v in b / se]), loglik=ll)


def cox_loglik(time: np.ndarray, event: np.ndarray, eta: np.ndarray, strata: np.ndarray) -> float:
    """The partial log-likelihood, with Efron's correction of ties, of given log hazards."""
    order = np.lexsort((-event, -time, strata))
    time, event, eta, strata = time[order], event[order], eta[order], strata[order]
    cuts, w = strata_cuts(strata), np.exp(np.clip(eta - eta.max(initial=0.0), -500, 500))
    ends = np.append(np.flatnonzero((np.diff(time) != 0) | (np.diff(strata) != 0)), len(time) - 1)
    firsts = np.append(0, ends[:-1] + 1)
    ties = np.add.reduceat(event, firsts).astype(int)
    which = np.repeat(np.arange(len(ends)), ties)
    share = (np.arange(len(which)) - np.repeat(np.cumsum(ties) - ties, ties)) / np.maximum(ties[which], 1)
    risk = running(w, cuts)[ends[which]] - share * np.add.reduceat(w * event, firsts)[which]
    return float((event * eta).sum() - (np.log(risk) + eta.max(initial=0.0)).sum())


def harmonic(n: np.ndarray) -> np.ndarray:
    """1 + 1/2 + ... + 1/n, exact sums up to 64 and Euler's expansion beyond."""
    n = np.asarray(n, float)
    table = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, 65))))
    x = np.maximum(n, 64)
    return np.where(n <= 64, table[np.minimum(n, 64).astype(int)], np.log(x) + np.euler_gamma + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4))


def null_residuals(time: np.ndarray, event: np.ndarray, strata: np.ndarray) -> np.ndarray:
    """Working residuals of the Cox model without regressors: events less Efron's cumulative hazards.

    Of m events at a time with r rows at risk the l-th adds 1 / (r - l) to the hazard, and a row with
    an event bears 1 - l / m of that.
    """
    order = np.lexsort((time, strata))
    t, e, s = time[order], event[order], strata[order]
    firsts = np.append(0, np.flatnonzero((np.diff(t) != 0) | (np.diff(s) != 0)) + 1)
    m = np.add.reduceat(e, firsts)
    at_risk = np.searchsorted(s, s[firsts], "right") - firsts
    jump = harmonic(at_risk) - harmonic(at_risk - m)
    hazard = running(jump, strata_cuts(s[firsts]))
    spared = np.where(m > 0, at_risk * jump / np.maximum(m, 1) - 1, 0)
    which = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(t))))
    out = np.empty(len(t))
    out[order] = e - hazard[which] + e * spared[which]
    return out
