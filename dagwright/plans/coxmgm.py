"""Mixed graphical models with censored variables.

Each censored variable adds its Cox partial likelihood, with an effect for each continuous variable and
a group of effects for each discrete one; the other variables' conditionals do not contain it, so its
term has parameters of its own and is fitted by its own proximal gradient.
"""

from __future__ import annotations

import math

import numpy as np

from dagwright.functions.regression import running, strata_cuts
from dagwright.operators.dataset import Data
from dagwright.operators.survival import likelihood_of_rows
from dagwright.plans.graph import UNDIRECTED, Graph
from dagwright.plans.mgm import Mgm


def five(lam) -> tuple[float, ...]:
    """Penalties of pairs: continuous, mixed, discrete, censored-continuous, censored-discrete."""
    lam = [lam] if isinstance(lam, (int, float)) else list(lam)
    return tuple(lam * 5 if len(lam) == 1 else lam)


def groups_of(data: Data) -> tuple[list[tuple[str, str, list[int]]], list[int]]:
    """Name, kind and places of the effects of each variable that is not censored, and the design columns in these places."""
    groups, cols = [], []
    for v in data.variables:
        if v.kind != "censored":
            own = data.columns[v.name]
            groups.append((v.name, v.kind, list(range(len(cols), len(cols) + len(own)))))
            cols += own
    return groups, cols


class CoxTerm:
    """Mean negative partial log-likelihood (Breslow's form of ties, risk sets by stratum) of one censored variable, with group penalties."""

    def __init__(self, data: Data, name: str):
        t, e, s = data.survival(name)
        order = np.lexsort((-t, s))
        m, t, self.event, s = data.local[order], t[order], e[order], s[order]
        self.cuts = strata_cuts(s)
        ends = np.append(np.flatnonzero((np.diff(t) != 0) | (np.diff(s) != 0)), len(m) - 1)
        self.last = np.repeat(ends, np.diff(np.append(-1, ends)))
        self.groups, cols = groups_of(data)
        x = m[:, cols]
        sd = x.std(axis=0)
        self.x = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)

    def smooth(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        eta = np.clip(self.x @ b, -50, 50)
        w = np.exp(eta)
        risk = running(w, self.cuts)[self.last]
        loss = -float((self.event * (eta - np.log(risk))).sum()) / len(w)
        # every row is at risk at each event time up to its own: sums of 1 / risk from the smallest time on
        share = np.zeros(len(w))
        np.add.at(share, self.last, self.event / risk)
        at_risk = running(share[::-1], len(w) - self.cuts[::-1])[::-1]
        return loss, self.x.T @ (w * at_risk - self.event) / len(w)

    def learn(self, continuous: float, discrete: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        b = np.zeros(self.x.shape[1]) if start is None else start.copy()
        y, t, big = b.copy(), 1.0, 1.0
        for _ in range(500):
            f, g = self.smooth(y)
            while True:
                new = y - g / big
                for _, kind, own in self.groups:
                    lam = continuous if kind == "continuous" else discrete * math.sqrt(len(own))
                    n = float(np.linalg.norm(new[own]))
                    new[own] *= max(0.0, 1 - lam / big / n) if n > 0 else 0.0
                d = new - y
                if self.smooth(new)[0] <= f + float(g @ d) + big / 2 * float(d @ d) + 1e-12 or big > 1e8:
                    break
                big *= 2
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            y, moved = new + (t - 1) / t_new * (new - b), float(np.linalg.norm(new - b))
            b, t = new, t_new
            if moved < 1e-6:
                break
        return b, self.smooth(b)[0]


class CoxRows:
    """The same term where rows are not held locally: proximal Newton steps, a pass over the rows each."""

    def __init__(self, data: Data, name: str):
        self.groups, cols = groups_of(data)
        self.n, self.k = data.n, len(cols)
        self.loglik = likelihood_of_rows(*data.cox_rows(name, cols), efron=False)

    def sums(self, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        ll, grad, hess = self.loglik(b)
        return -ll / self.n, -grad / self.n, hess / self.n

    def smooth(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        return self.sums(b)[:2]

    def penalties(self, continuous: float, discrete: float) -> list[tuple[float, list[int]]]:
        return [(continuous if kind == "continuous" else discrete * math.sqrt(len(own)), own) for _, kind, own in self.groups]

    def least(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, penalties: list[tuple[float, list[int]]]) -> np.ndarray:
        """Where the quadratic of gradient g and information h at b, with the penalties, is least."""
        big = max(float(np.linalg.eigvalsh(h)[-1]), 1e-12)
        x, y, t = b.copy(), b.copy(), 1.0
        for _ in range(20_000):
            new = y - (g + h @ (y - b)) / big
            for lam, own in penalties:
                n = float(np.linalg.norm(new[own]))
                new[own] *= max(0.0, 1 - lam / big / n) if n > 0 else 0.0
            if (y - new) @ (new - x) > 0:  # restart the momentum
                t = 1.0
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            moved = float(np.linalg.norm(new - x))
            x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
            if moved < 1e-10:
                break
        return x

    def learn(self, continuous: float, discrete: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        b = np.zeros(self.k) if start is None else start.copy()
        penalties = self.penalties(continuous, discrete)
        if not self.k:
            return b, self.smooth(b)[0]
        cost = lambda v: sum(lam * float(np.linalg.norm(v[own])) for lam, own in penalties)
        f, g, h = self.sums(b)
        for _ in range(100):
            d = self.least(b, g, h, penalties) - b
            if np.linalg.norm(d) < 1e-6:  # so near that the quadratic is the loss
                return b + d, f + float(g @ d + d @ h @ d / 2)
            gain, t = float(g @ d) + cost(b + d) - cost(b), 1.0
            while True:
                new = b + t * d
                f_new, g_new, h_new = self.sums(new)
                if f_new + cost(new) <= f + cost(b) + 1e-4 * t * gain + 1e-12 or t < 1e-6:
                    break
                t /= 2
            b, f, g, h = new, f_new, g_new, h_new
        return b, f


def parts(data: Data) -> tuple[Mgm, dict[str, CoxTerm | CoxRows]]:
    censored = [v.name for v in data.variables if v.kind == "censored"]
    term = CoxRows if data.local is None else CoxTerm
    return Mgm(data.without(censored)), {c: term(data, c) for c in censored}


def fit(model: Mgm, terms: dict[str, CoxTerm | CoxRows], data: Data, lam: tuple[float, ...], start=None) -> tuple[Graph, tuple, float, int]:
    got = model.learn(lam[:3], start and start[0])
    g = Graph(data.names(), UNDIRECTED, dict(got.graph.marks), algorithm="CoxMGM", params={"lambda": list(lam)})
    loss, count, effects = got.loss, got.count, {}
    for name, term in terms.items():
        effects[name], own = term.learn(lam[3], lam[4], start and start[1][name])
        loss, count = loss + own, count + int(np.count_nonzero(effects[name]))
        for v, _, cols in term.groups:
            if np.abs(effects[name][cols]).sum() > 1e-12:
                g.add(name, v)
    return g, (got.params, effects), loss, count


def coxmgm(data: Data, lam=0.2) -> Graph:
    return fit(*parts(data), data, five(lam))[0]


def coxmgm_path(data: Data, lambdas: list[float]) -> dict:
    """Graphs along descending penalties with log-likelihoods, AIC and BIC."""
    model, terms = parts(data)
    start, rows, graphs = None, [], []
    for lam in sorted(lambdas, reverse=True):
        g, start, loss, k = fit(model, terms, data, five(lam), start)
        ll = -data.n * loss
        graphs.append(g)
        rows.append({"lambda": lam, "loglik": ll, "nParams": k, "AIC": 2 * k - 2 * ll, "BIC": math.log(data.n) * k - 2 * ll})
    pick = lambda k: graphs[min(range(len(rows)), key=lambda i: rows[i][k])]
    return {"graphs": graphs, "rows": rows, "aic": pick("AIC"), "bic": pick("BIC")}


def coxmgm_cv(data: Data, lambdas: list[float], folds: int = 5, seed: int = 0) -> dict:
    """Mean held-out loss of each penalty, and the graphs of the least and of the largest within one deviation of it."""
    from dagwright.plans.resample import one_se, split, summary

    lams, losses = sorted(lambdas, reverse=True), {}
    for train, test in split(data, folds, seed):
        (model, terms), (_, other), start = parts(train), parts(test), None
        for lam in lams:
            _, start, _, _ = fit(model, terms, train, five(lam), start)
            held = model.smooth(start[0], test.without(list(terms)), slope=False)[0]
            losses.setdefault(lam, []).append(held + sum(other[c].smooth(start[1][c])[0] for c in terms))
    rows = [{"lambda": lam} | summary(losses[lam]) for lam in lams]
    best, se = min(rows, key=lambda r: r["mean"])["lambda"], rows[one_se(rows)]["lambda"]
    return {"rows": rows, "min": coxmgm(data, best), "1se": coxmgm(data, se)}
