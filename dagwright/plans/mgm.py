"""Mixed graphical models: pseudolikelihood of Gaussian and categorical variables with group penalties.

The conditionals of continuous variables follow from moments, one pass for all fits. Those of discrete
ones are sums over rows: a pass gives their loss, gradient and information, and the accelerated proximal
gradient works on parameters alone until the next pass. Where the information would have more than
`INFORMATION` numbers, each evaluation of loss or gradient is a pass.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Callable

import numpy as np

from dagwright.operators.dataset import Data
from dagwright.plans.graph import UNDIRECTED, Graph

#: Numbers in the information of the discrete variables' conditionals at most.
INFORMATION = 2_000_000


@dataclasses.dataclass
class Fitted:
    graph: Graph
    params: np.ndarray
    loss: float
    count: int

    def criteria(self, n: int) -> dict:
        ll = -n * self.loss
        return {"loglik": ll, "nParams": self.count, "AIC": 2 * self.count - 2 * ll, "BIC": math.log(n) * self.count - 2 * ll}


class Mgm:
    """Parameters in one vector: a (p), log-free b (p), B (p x p), theta (p x L), phi (L x L), c (L)."""

    def __init__(self, data: Data, scale: tuple[np.ndarray, np.ndarray] | None = None):
        if any(v.kind == "censored" for v in data.variables):
            raise ValueError("a mixed graphical model has no censored variables")
        self.data, self.held, self._moments = data, None, None
        self.xs = [v.name for v in data.variables if v.kind == "continuous"]
        self.ds = [v.name for v in data.variables if v.kind == "discrete"]
        self.x = [data.columns[v][0] for v in self.xs]
        self.p, self.levels = len(self.x), [len(data.columns[v]) + 1 for v in self.ds]
        self.cuts = np.concatenate(([0], np.cumsum(self.levels))).astype(int)
        self.L = int(self.cuts[-1])
        self.first_levels = {k: self.cuts[:-1][np.array(self.levels) == k] for k in sorted(set(self.levels))}
        g, n = data.gram(), max(1, data.n)
        mean = g[0, 1:] / n
        self.mean, self.sd = scale or (mean[self.x], np.sqrt(np.maximum((np.diag(g)[1:] / n - mean**2)[self.x] * n / max(1, n - 1), 1e-300)))
        rates = [np.concatenate(([1 - mean[data.columns[v]].sum()], mean[data.columns[v]])) for v in self.ds]
        self.wx = np.ones(self.p)
        self.wd = np.array([math.sqrt(float((r * (1 - r)).sum())) for r in rates]) if rates else np.zeros(0)
        self.shapes = [(self.p,), (self.p,), (self.p, self.p), (self.p, self.L), (self.L, self.L), (self.L,)]
        self.size = sum(math.prod(s) for s in self.shapes)
        # both copies of a symmetric parameter move together, so that each counts half in products of parameters
        self.half = self.join([np.ones(self.p), np.ones(self.p), np.full(self.shapes[2], 0.5), np.ones(self.shapes[3]), np.full(self.shapes[4], 0.5), np.ones(self.L)])
        self.own = np.zeros((self.L, self.L), bool)
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            self.own[a:b, a:b] = True
        logs = [np.log((r * n + 1) / (n + len(r))) for r in rates]
        self.first = self.join([np.zeros(self.p), np.ones(self.p), np.zeros(self.shapes[2]), np.zeros(self.shapes[3]), np.zeros(self.shapes[4]), np.concatenate(logs) if logs else np.zeros(0)])

    def join(self, parts) -> np.ndarray:
        return np.concatenate([np.asarray(x, float).ravel() for x in parts])

    def split(self, v: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            k = math.prod(s)
            out.append(v[at : at + k].reshape(s))
            at += k
        return out

    def blocks(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (m[:, self.x] - self.mean) / self.sd
        parts = []
        for v in self.ds:
            own = m[:, self.data.columns[v]]
            parts += [1 - own.sum(axis=1, keepdims=True), own]
        return x, np.hstack(parts) if parts else np.zeros((len(m), 0))

    def smooth(self, v: np.ndarray, data: Data | None = None, slope: bool = True) -> tuple[float, np.ndarray]:
        """Mean loss and, with slope, gradient; infinite where a precision is not positive."""
        a, b, B, th, ph, c = self.split(v)
        if (b <= 0).any():
            return math.inf, np.zeros_like(v)
        data = data or self.data
        held = None
        if data is self.data and data.local is not None:
            held = self.held = self.held or self.blocks(data.local)

        def passed(m):
            x, d = held or self.blocks(m)
            fit = (a + x @ B + d @ th.T) / b
            res = fit - x
            eta = c + x @ th + d @ ph
            prob, loss = np.empty_like(eta), 0.0
            for k, first in self.first_levels.items():  # variables of as many levels, level by level
                cols = [first + j for j in range(k)]
                each = [eta[:, own] for own in cols]
                top = functools.reduce(np.maximum, each)
                z = [np.exp(e - top) for e in each]
                total = functools.reduce(np.add, z)
                for own, e in zip(cols, z, strict=True):
                    prob[:, own] = e / total
                loss += float((np.log(total) + top).sum())
            loss -= float((eta * d).sum())
            loss += float(-0.5 * len(x) * np.log(b).sum() + 0.5 * (b * res**2).sum())
            if not slope:
                return np.array([loss])
            miss = prob - d
            gb, gp = res.T @ x, d.T @ miss
            return np.concatenate([[loss], self.join([res.sum(axis=0), (-0.5 / b + 0.5 * res**2 - res * fit).sum(axis=0), gb + gb.T, res.T @ d + x.T @ miss, gp + gp.T, miss.sum(axis=0)])])

        got = data.sum_rows(passed, 1 + self.size * slope) / max(1, data.n)
        if not slope:
            return float(got[0]), v
        _, _, gB, _, gP, _ = parts = self.split(got[1:])
        np.fill_diagonal(gB, 0)
        gP[self.own] = 0
        return float(got[0]), self.join(parts)

    def norms(self, th: np.ndarray, ph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms of the groups of a continuous and a discrete variable, and of two discrete ones."""
        if not self.levels:
            return np.zeros((self.p, 0)), np.zeros((0, 0))
        at = self.cuts[:-1]
        return np.sqrt(np.add.reduceat(th**2, at, axis=1)), np.sqrt(np.add.reduceat(np.add.reduceat(ph**2, at, axis=0), at, axis=1))

    def prox(self, v: np.ndarray, step: float, lam: tuple[float, float, float]) -> tuple[np.ndarray, float]:
        """Soft thresholds of continuous pairs and group thresholds of the others; and the penalty."""
        a, b, B, th, ph, c = (x.copy() for x in self.split(v))
        total = 0.0
        w = lam[0] * np.outer(self.wx, self.wx)
        B = np.sign(B) * np.maximum(np.abs(B) - step * w, 0)
        np.fill_diagonal(B, 0)
        total += float((np.triu(w, 1) * np.abs(np.triu(B, 1))).sum())
        shrink = lambda n, w: np.where(n > 0, np.maximum(1 - step * w / np.where(n > 0, n, 1), 0), 0)
        if self.levels:
            mixed, both = self.norms(th, ph)
            w = lam[1] * np.outer(self.wx, self.wd)
            keep = shrink(mixed, w)
            th *= np.repeat(keep, self.levels, axis=1)
            total += float((w * mixed * keep).sum())
            w = lam[2] * np.outer(self.wd, self.wd)
            keep = shrink(both, w)
            np.fill_diagonal(keep, 0)
            ph *= np.repeat(np.repeat(keep, self.levels, axis=0), self.levels, axis=1)
            total += float((np.triu(w, 1) * both * keep).sum())
        ph[self.own] = 0
        return self.join([a, np.maximum(b, 1e-6), B, th, ph, c]), total

    def moments(self) -> np.ndarray:
        """Of 1, the scaled continuous variables and all levels, as means over rows."""
        if self._moments is None:
            w = 1 + self.p + self.L

            def passed(m):
                z = np.hstack([np.ones((len(m), 1)), *self.blocks(m)])
                return (z.T @ z).ravel()

            self._moments = self.data.sum_rows(passed, w * w).reshape(w, w) / max(1, self.data.n)
        return self._moments

    def gaussian(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        """What the continuous variables' conditionals add to `smooth`, from moments."""
        a, b, B, th, _, _ = self.split(v)
        m, p = self.moments(), self.p
        fit = np.vstack([a[None], B, th.T]) / b
        res = fit.copy()
        res[1 : 1 + p] -= np.eye(p)
        mr = m @ res
        squares = np.einsum("is,is->s", res, mr)
        gB = mr[1 : 1 + p].T
        gB = gB + gB.T
        np.fill_diagonal(gB, 0)
        zero = np.zeros(self.shapes[4])
        return float(-0.5 * np.log(b).sum() + 0.5 * (b * squares).sum()), self.join([mr[0], -0.5 / b + 0.5 * squares - np.einsum("is,is->s", fit, mr), gB, mr[1 + p :].T, zero, np.zeros(self.L)])

    def own_columns(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Levels of each discrete variable, and those of the others."""
        every = np.arange(self.L)
        return [(every[a:b], np.delete(every, np.s_[a:b])) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def information_size(self) -> int:
        return sum((1 + self.p + self.L - k) ** 2 * k * (k + 1) // 2 for k in self.levels)

    def effects(self, v: np.ndarray) -> list[np.ndarray]:
        """Of each discrete variable the effects of 1, the continuous variables and others' levels on its levels."""
        _, _, _, th, ph, c = self.split(v)
        return [np.vstack([c[None, own], th[:, own], ph[np.ix_(others, own)]]) for own, others in self.own_columns()]

    def softmax(self, v: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Loss of the discrete variables' conditionals; and of each its effects, their gradient and information, in one pass."""
        if not self.levels:
            return 0.0, []
        effects, columns, p = self.effects(v), self.own_columns(), self.p
        sizes = [e.size + len(e) ** 2 * e.shape[1] * (e.shape[1] + 1) // 2 for e in effects]
        local = self.data.local is not None

        def passed(m):
            if local:
                self.held = self.held or self.blocks(m)
            x, d = self.held if local else self.blocks(m)
            loss, out = 0.0, []
            for w, (own, others) in zip(effects, columns, strict=True):
                z = np.hstack([np.ones((len(x), 1)), x, d[:, others]])
                eta = z @ w
                top = eta.max(axis=1, keepdims=True)
                prob = np.exp(eta - top)
                total = prob.sum(axis=1, keepdims=True)
                prob /= total
                loss += float((np.log(total) + top).sum() - (eta * d[:, own]).sum())
                out.append((z.T @ (prob - d[:, own])).ravel())
                for j in range(len(own)):
                    for k in range(j, len(own)):
                        out.append((z.T @ (z * (prob[:, j] * ((j == k) - prob[:, k]))[:, None])).ravel())
            return np.concatenate([[loss], *out])

        got = self.data.sum_rows(passed, 1 + sum(sizes)) / max(1, self.data.n)
        found, at = [], 1
        for w, size in zip(effects, sizes, strict=True):
            r, k = w.shape
            g, own = got[at : at + w.size].reshape(r, k), iter(got[at + w.size : at + size].reshape(-1, r, r))
            h = np.zeros((r, k, r, k))
            for i in range(k):
                for j in range(i, k):
                    h[:, i, :, j] = block = next(own)
                    h[:, j, :, i] = block.T
            found.append((w, g, h.reshape(r * k, r * k)))
            at += size
        return float(got[0]), found

    def near(self, at: tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]], v: np.ndarray) -> tuple[float, np.ndarray]:
        """The discrete variables' loss at v by its second order around where `softmax` was asked, and its gradient."""
        f, p = at[0], self.p
        th, ph, c = np.zeros(self.shapes[3]), np.zeros(self.shapes[4]), np.zeros(self.L)
        for (w, g, h), now, (own, others) in zip(at[1], self.effects(v), self.own_columns(), strict=True):
            d = (now - w).ravel()
            hd = h @ d
            f += float(g.ravel() @ d + d @ hd / 2)
            slope = g + hd.reshape(w.shape)
            c[own], th[:, own], ph[np.ix_(others, own)] = slope[0], slope[1 : 1 + p], slope[1 + p :]
        return f, self.join([np.zeros(self.p), np.zeros(self.p), np.zeros(self.shapes[2]), th, ph + ph.T, c])

    def descend(self, smooth: Callable[[np.ndarray, bool], tuple[float, np.ndarray]], x: np.ndarray, lam: tuple[float, float, float], eps: float, most: int) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient with backtracking and restarts; it ends when steps are small and edges stay."""
        y, t, big, still, edges = x.copy(), 1.0, 1.0, 0, None
        f_x, last = smooth(x, False)[0], math.inf
        for _ in range(most):
            f, g = smooth(y, True)
            while True:
                new, pen = self.prox(y - g / big, 1 / big, lam)
                f_new, d = smooth(new, False)[0], new - y
                if f_new <= f + float((self.half * g) @ d) + big / 2 * float((self.half * d) @ d) + 1e-12 or big > 1e8:
                    break
                big *= 2
            objective = f_new + pen
            if objective > last:  # restart the momentum
                y, t = x.copy(), 1.0
                last = math.inf
                continue
            last = objective
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            move = float(np.linalg.norm(new - x)) / max(1.0, float(np.linalg.norm(x)))
            y, x, t, f_x, big = new + (t - 1) / t_new * (new - x), new, t_new, f_new, big * 0.9
            now = self.edge_set(x)
            still, edges = (still + 1 if now == edges else 0), now
            if move < eps and still >= 3:
                break
        return x, f_x

    def learn(self, lam: tuple[float, float, float], start: np.ndarray | None = None, eps: float = 1e-5, most: int = 500) -> Fitted:
        """Proximal Newton steps, a pass each, until they are small; without room for their information, first-order steps."""
        x = self.first.copy() if start is None else start.copy()
        if self.information_size() > INFORMATION:
            x, f = self.descend(self.smooth_of_data, x, lam, eps, most)
            return Fitted(self.graph(x, lam), x, f, self.count(x))
        penalty = lambda v: self.prox(v, 0.0, lam)[1]
        at = self.softmax(x)
        f, edges = self.gaussian(x)[0] + at[0], None
        for _ in range(most):

            def model(v: np.ndarray, slope: bool, at=at) -> tuple[float, np.ndarray]:
                if (self.split(v)[1] <= 0).any():
                    return math.inf, np.zeros_like(v)
                (f1, g1), (f2, g2) = self.gaussian(v), self.near(at, v)
                return f1 + f2, g1 + g2

            new, f_new = self.descend(model, x, lam, eps / 100, 20 * most)
            move = float(np.linalg.norm(new - x)) / max(1.0, float(np.linalg.norm(x)))
            now = self.edge_set(new)
            if move < eps and now == edges:  # so near that the model is the loss
                x, f = new, f_new
                break
            gain, t = f_new + penalty(new) - f - penalty(x), 1.0
            while True:
                tried = x + t * (new - x)
                there = self.softmax(tried)
                f_tried = self.gaussian(tried)[0] + there[0]
                if f_tried + penalty(tried) <= f + penalty(x) + 1e-4 * t * min(gain, 0.0) + 1e-12 or t < 1e-6:
                    break
                t /= 2
            x, f, at, edges = tried, f_tried, there, now
            if not self.levels:  # the model is the loss
                break
        return Fitted(self.graph(x, lam), x, f, self.count(x))

    def smooth_of_data(self, v: np.ndarray, slope: bool) -> tuple[float, np.ndarray]:
        return self.smooth(v, slope=slope)

    def strengths(self, v: np.ndarray) -> np.ndarray:
        """Of each pair of variables, the continuous ones first, in the upper triangle."""
        _, _, B, th, ph, _ = self.split(v)
        mixed, both = self.norms(th, ph)
        out = np.zeros((self.p + len(self.ds),) * 2)
        out[: self.p, : self.p], out[: self.p, self.p :], out[self.p :, self.p :] = np.abs(B), mixed, both
        return np.triu(out, 1)

    def edge_set(self, v: np.ndarray) -> bytes:
        return np.packbits(self.strengths(v) > 2e-16).tobytes()

    def graph(self, v: np.ndarray, lam) -> Graph:
        g = Graph(self.data.names(), UNDIRECTED, algorithm="MGM", params={"lambda": list(lam)})
        names = [*self.xs, *self.ds]
        for i, j in np.argwhere(self.strengths(v) > 2e-16):
            g.add(names[i], names[j])
        return g

    def count(self, v: np.ndarray) -> int:
        _, _, B, th, ph, _ = self.split(v)
        return 2 * self.p + self.L + int(np.count_nonzero(np.triu(B, 1)) + np.count_nonzero(th) + np.count_nonzero(np.triu(ph, 1)))

    def lambda_max(self) -> float:
        """The least penalty without edges: the largest weighted block of the gradient at independence."""
        _, _, B, th, ph, _ = self.split(self.smooth(self.first)[1])
        mixed, both = self.norms(th, ph)
        np.fill_diagonal(both, 0)
        each = [np.abs(B), mixed / np.maximum(np.outer(self.wx, self.wd), 1e-12), both / np.maximum(np.outer(self.wd, self.wd), 1e-12)]
        return max(float(x.max(initial=0.0)) for x in each)


def triple(lam) -> tuple[float, float, float]:
    lam = [lam] if isinstance(lam, (int, float)) else list(lam)
    return tuple(lam * 3 if len(lam) == 1 else lam)


def mgm(data: Data, lam=(0.2, 0.2, 0.2)) -> Graph:
    return Mgm(data).learn(triple(lam)).graph


def grid(model: Mgm, n_lambda: int = 30) -> list[float]:
    """Log-spaced penalties from the largest useful one down to .05 of it (.1 if there are more columns than rows)."""
    n, p = model.data.n, max(2, len(model.data.variables))
    top = min(model.lambda_max(), 10 * math.sqrt(math.log10(p) / n))
    low = (0.05 if n > p else 0.1) * top
    return [float(x) for x in np.geomspace(top, low, n_lambda)]


def mgm_path(data: Data, lambdas: list[float] | None = None, n_lambda: int = 30) -> dict:
    """Graphs along descending penalties, each fit from the last one's parameters, and the AIC and BIC choices."""
    model, start, rows, graphs = Mgm(data), None, [], []
    for lam in sorted(lambdas or grid(model, n_lambda), reverse=True):
        got = model.learn(triple(lam), start)
        start = got.params
        graphs.append(got.graph)
        rows.append({"lambda": lam} | got.criteria(data.n))
    pick = lambda k: graphs[min(range(len(rows)), key=lambda i: rows[i][k])]
    return {"graphs": graphs, "rows": rows, "aic": pick("AIC"), "bic": pick("BIC")}
