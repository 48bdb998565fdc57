"""Conditional-independence tests in batches, by the kinds of both variables.

Linear tests come from one matrix of moments, whatever their number. Discrete pairs take batches of
logistic fits, one pass over the rows for each Newton step of a whole batch. Censored variables take
Cox fits; given ones stand for themselves by their working residuals. A test whose fits fail both ways counts as
dependent, with p = 0.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from dagwright.functions.distributions import chi2_upper, f_upper_all, t_two_sided_all
from dagwright.functions.regression import likelihood_ratio, logistic_batch, multinomial_loglik
from dagwright.operators.dataset import Data

#: Logistic fits that share a pass, and linear tests that are solved at once.
BATCH, LINEAR = 512, 20_000

Test = tuple[str, str, tuple[str, ...]]


class DataTest:
    """p values of x independent of y given z, from data; each test is worked out once."""

    def __init__(self, data: Data):
        self.data, self.known = data, {}
        self.cov = data.covariance()
        self.fits: dict = {}

    def nodes(self) -> list[str]:
        return self.data.names()

    def p_values(self, tests: list[Test]) -> list[float]:
        keys = [(min(x, y), max(x, y), tuple(sorted(z))) for x, y, z in tests]
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        discrete, linear = [], defaultdict(list)
        for k in new:
            x, y, z = k
            kinds = {self.data.kind(x), self.data.kind(y)}
            if "censored" in kinds:
                self.known[k] = self.survival(x, y, z)
            elif "continuous" in kinds:
                if self.data.kind(x) != "continuous" or self.data.kind(y) == "continuous" and len(self.data.columns[y]) > 1:
                    x, y = y, x
                c = self.columns(z)
                linear[len(self.data.columns[y]), len(c)].append((k, [self.data.columns[x][0], *self.data.columns[y], *c]))
            else:
                discrete.append(k)
        for (tested, given), own in linear.items():
            for i in range(0, len(own), LINEAR):
                some = own[i : i + LINEAR]
                for (k, _), p in zip(some, self.linear(np.array([c for _, c in some]), tested, given), strict=True):
                    self.known[k] = float(p)
        for i in range(0, len(discrete), BATCH):
            self.logistic(discrete[i : i + BATCH])
        return [self.known[k] for k in keys]

    def columns(self, names) -> list[int]:
        return [c for v in names for c in self.data.regressors[v]]

    def linear(self, cols: np.ndarray, tested: int, given: int) -> np.ndarray:
        """p values of the F test (of one column: the t test) of `tested` columns in least-squares fits of the first column on them and `given` others.

        A test a row of cols, all solved at once from the covariances; one that cannot be solved has p = 0.
        """
        df = self.data.n - 1 - tested - given
        if df < 1:
            return np.zeros(len(cols))
        m = self.cov[cols[:, :, None], cols[:, None, :]]
        d = np.sqrt(np.maximum(np.einsum("tii->ti", m), 1e-300))
        m = m / (d[:, :, None] * d[:, None, :])
        head = 1 + tested
        if given:
            inner = m[:, head:, head:]
            fine = np.abs(np.linalg.det(inner)) > 1e-12
            inner = np.where(fine[:, None, None], inner, np.eye(given))
            m = m[:, :head, :head] - m[:, :head, head:] @ np.linalg.solve(inner, m[:, head:, :head])
        else:
            fine = np.ones(len(cols), bool)
        rest = m[:, 1:, 1:]
        fine &= (m[:, 0, 0] > 1e-10) & (np.einsum("tii->ti", rest).min(axis=1) > 1e-10) & np.isfinite(m).all(axis=(1, 2))
        fine &= np.abs(np.linalg.det(np.where(fine[:, None, None], rest, np.eye(tested)))) > 1e-10 ** tested
        rest = np.where(fine[:, None, None], rest, np.eye(tested))
        own, both = np.where(fine, m[:, 0, 0], 1.0), np.where(fine[:, None], m[:, 0, 1:], 0.0)
        explained = np.einsum("ti,ti->t", both, np.linalg.solve(rest, both[:, :, None])[:, :, 0])
        left = np.maximum(own - explained, 1e-300)
        if tested == 1:
            p = t_two_sided_all(np.sqrt(np.maximum(explained, 0) * df / left), np.full(len(cols), float(df)))
        else:
            p = f_upper_all(np.maximum(explained / tested / left * df, 1e-15), tested, np.full(len(cols), float(df)))
        return np.where(fine, p, 0.0)

    def logistic(self, keys: list[Test]) -> None:
        """Likelihood-ratio tests with the variable of fewer levels as the target, the other where that fails."""
        left = keys
        for swap in (False, True):
            roles = []
            for x, y, z in left:
                few, many = sorted((x, y), key=lambda v: (len(self.data.columns[v]), v))
                roles.append((many, few, z) if swap else (few, many, z))
            models = [(t, cols) for t, other, z in roles for cols in (self.columns([other, *z]), self.columns(z))]
            ask = [(y, c) for t, c in models for y in self.data.columns[t]]
            ask = [(y, list(c)) for y, c in dict.fromkeys((y, tuple(c)) for y, c in ask) if (y, c) not in self.fits]
            for (y, c), fit in zip(ask, logistic_batch(self.data, ask), strict=True):
                self.fits[y, tuple(c)] = fit
            fits = [[self.fits[y, tuple(c)] for y in self.data.columns[t]] for t, c in models]
            fine = [None not in f for f in fits]
            ll = iter(multinomial_loglik(self.data, [(self.data.columns[t], [c] * len(f), [x[0] for x in f]) for (t, c), f, ok in zip(models, fits, fine, strict=True) if ok]))
            ll = [next(ll) if ok else None for ok in fine]
            again = []
            for i, ((t, other, _), key) in enumerate(zip(roles, left, strict=True)):
                full, less = ll[2 * i], ll[2 * i + 1]
                if full is None or less is None:
                    again.append(key)
                    self.known[key] = 0.0
                else:
                    self.known[key] = float(likelihood_ratio(full, less, len(self.data.columns[t]) * len(self.data.columns[other]))[1])
            left = again

    def survival(self, x: str, y: str, z: tuple[str, ...]) -> float:
        """Cox: Wald test of one column, likelihood ratio of several.

        Two censored variables are independent (p = 1); given a third one, a censored variable is dependent (p = 0).
        """
        kind = self.data.kind
        if kind(x) == "censored" == kind(y):
            return 1.0
        if kind(x) != "censored":
            x, y = y, x
        if any(kind(v) == "censored" for v in z):
            return 0.0
        b, c = self.data.columns[y], self.columns(z)
        try:
            full = self.data.cox(x, [*b, *c])
            if len(b) == 1:
                return float(full.p[0])
            return chi2_upper(max(2 * (full.loglik - self.data.cox(x, c).loglik), 1e-15), len(b))
        except (ValueError, np.linalg.LinAlgError):
            return 0.0


class GraphTest:
    """d-separation in a known directed graph, over some of its nodes: p is 1 or 0."""

    def __init__(self, graph, observed=None):
        self.graph, self.observed = graph, list(observed or graph.nodes)

    def nodes(self) -> list[str]:
        return self.observed

    def p_values(self, tests: list[Test]) -> list[float]:
        return [1.0 if self.graph.d_separated(x, y, z) else 0.0 for x, y, z in tests]
