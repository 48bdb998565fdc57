"""Score-based search: grow-shrink Markov boundaries, BOSS and GRaSP, over scores from sufficient statistics."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np

from dagwright.functions.regression import logistic_batch, multinomial_loglik
from dagwright.operators.dataset import Data
from dagwright.plans.graph import DAG, Graph, cpdag, extension
from dagwright.plans.knowledge import Knowledge


class DegenerateGaussian:
    """Local scores from the covariance of dummy-expanded columns, in one pass over the rows; smaller is better."""

    def __init__(self, data: Data, penalty: float = 1.0):
        if any(v.kind == "censored" for v in data.variables):
            raise ValueError("this score has no form for censored variables")
        self.data, self.penalty, self.cov, self.known = data, penalty, data.covariance(), {}

    def nodes(self) -> list[str]:
        return self.data.names()

    def local(self, y: str, parents: frozenset[str]) -> float:
        key = (y, parents)
        if key not in self.known:
            a = self.data.columns[y]
            b = [c for v in sorted(parents) for c in self.data.columns[v]]
            s = self.cov[np.ix_(a, a)]
            out = 0.0
            if b:
                cond = s - self.cov[np.ix_(a, b)] @ np.linalg.pinv(self.cov[np.ix_(b, b)]) @ self.cov[np.ix_(b, a)]
                sign, det = np.linalg.slogdet(cond)
                out = math.inf if sign <= 0 else self.data.n * (det - np.linalg.slogdet(s)[1]) + self.penalty * math.log(self.data.n) * len(a) * len(b)
            self.known[key] = out
        return self.known[key]


class RegressionBic:
    """-2 (log-likelihood - that without parents) + penalty log(n) k, by the kind of the variable; a failed fit scores +inf.

    A censored parent is its working residual.
    """

    def __init__(self, data: Data, penalty: float = 1.0):
        self.data, self.penalty, self.known = data, penalty, {}

    def nodes(self) -> list[str]:
        return self.data.names()

    def local(self, y: str, parents: frozenset[str]) -> float:
        key = (y, parents)
        if key not in self.known:
            try:
                self.known[key] = self.fitted(y, [c for v in sorted(parents) for c in self.data.regressors[v]])
            except (ValueError, np.linalg.LinAlgError):
                self.known[key] = math.inf
        return self.known[key]

    def fitted(self, y: str, cols: list[int]) -> float:
        d = self.data
        if not cols:
            return 0.0
        own = d.columns[y]
        if d.kind(y) == "continuous":
            s = d.covariance()
            rest = s[own[0], own[0]] - s[own[0], cols] @ np.linalg.solve(s[np.ix_(cols, cols)], s[cols, own[0]])
            return d.n * math.log(max(rest, 1e-300) / s[own[0], own[0]]) + self.penalty * math.log(d.n) * len(cols)
        if d.kind(y) == "censored":
            gain = d.cox(y, cols).loglik - d.cox(y, []).loglik
            return -2 * gain + self.penalty * math.log(d.gram()[0, own[1] + 1]) * len(cols)
        fits = logistic_batch(d, [(c, cols) for c in own] + [(c, []) for c in own])
        if None in fits:
            return math.inf
        k = len(own)
        ll = multinomial_loglik(d, [(own, [cols] * k, [f[0] for f in fits[:k]]), (own, [[]] * k, [f[0] for f in fits[k:]])])
        return -2 * (ll[0] - ll[1]) + self.penalty * math.log(d.n) * k * len(cols)


def grow_shrink(score, y: str, among: list[str]) -> frozenset[str]:
    """Adds the best of `among` while the score falls, then takes the worst away while it does."""
    own, best = frozenset(), score.local(y, frozenset())
    while rest := [v for v in among if v not in own]:
        s, v = min((score.local(y, own | {v}), v) for v in rest)
        if s >= best - 1e-9:
            break
        own, best = own | {v}, s
    while own:
        s, v = min((score.local(y, own - {v}), v) for v in own)
        if s >= best - 1e-9:
            break
        own, best = own - {v}, s
    return own


def grow_shrink_mb(data: Data, target: str, penalty: float = 1.0) -> list[str]:
    kinds = {v.kind for v in data.variables}
    score = (RegressionBic if "censored" in kinds else DegenerateGaussian)(data, penalty)
    return sorted(grow_shrink(score, target, [v for v in data.names() if v != target]))


class Orders:
    """Parents and scores of variable orders; parents of a variable depend on the set before it alone."""

    def __init__(self, score, knowledge: Knowledge | None = None):
        self.score, self.knowledge, self.known = score, knowledge, {}

    def parents(self, y: str, before: frozenset[str]) -> frozenset[str]:
        key = (y, before)
        if key not in self.known:
            k = self.knowledge
            among = sorted(v for v in before if not (k and k.is_forbidden(v, y)))
            got = grow_shrink(self.score, y, among)
            self.known[key] = got | {v for v in before if k and k.is_required(v, y)}
        return self.known[key]

    def of(self, order: list[str]) -> tuple[float, dict[str, frozenset[str]]]:
        seen, total, out = frozenset(), 0.0, {}
        for v in order:
            out[v] = self.parents(v, seen)
            total += self.score.local(v, out[v])
            seen |= {v}
        return total, out

    def allowed(self, order: list[str]) -> bool:
        k = self.knowledge
        if not k:
            return True
        at = {v: i for i, v in enumerate(order)}
        return all(at[a] < at[b] for a, b in k.required if a in at and b in at) and (not k.tiers or all(k.tier[a] <= k.tier[b] for a, b in zip(order, order[1:], strict=False)))

    def start(self, rng: random.Random, min_degree: bool = False) -> list[str]:
        names = sorted(self.score.nodes())
        rng.shuffle(names)
        tier = self.knowledge.tier if self.knowledge and self.knowledge.tiers else dict.fromkeys(names, 0)
        if min_degree:
            return [v for t in sorted(set(tier.values())) for v in self.by_degree([w for w in names if tier[w] == t])]
        return sorted(names, key=lambda v: tier[v])

    def by_degree(self, names: list[str]) -> list[str]:
        """Variables as they are taken from the graph of grow-shrink boundaries, always one of least degree, its neighbours joined; the last taken comes first."""
        near = {v: set() for v in names}
        for v in names:
            for w in grow_shrink(self.score, v, [w for w in names if w != v]):
                near[v].add(w)
                near[w].add(v)
        out = []
        while near:
            v = min(near, key=lambda w: len(near[w]))
            around = near.pop(v)
            for w in around:
                near[w] = (near[w] | around) - {v, w}
            out.append(v)
        return out[::-1]

    def graph(self, order: list[str], algorithm: str, penalty: float) -> Graph:
        g = Graph(sorted(order), DAG)
        for v, own in self.of(order)[1].items():
            for w in own:
                g.orient(w, v)
        return cpdag(g).copy(algorithm=algorithm, params={"penalty": penalty})


def best_moves(orders: Orders, order: list[str]) -> list[str]:
    """Moves each variable in turn to its best place until none moves."""
    best, moved = orders.of(order)[0], True
    while moved:
        moved = False
        for v in list(order):
            rest = [w for w in order if w != v]
            for i in range(len(order)):
                new = [*rest[:i], v, *rest[i:]]
                if new != order and orders.allowed(new) and (s := orders.of(new)[0]) < best - 1e-9:
                    order, best, moved = new, s, True
    return order


def backward(score, g: Graph, knowledge: Knowledge | None = None) -> Graph:
    """Greedy deletions between equivalence classes (Chickering 2002), as long as the score falls."""
    while True:
        best = None
        for x in sorted(g.nodes):
            for y in g.neighbors(x):
                if g.directed(y, x) or knowledge and not knowledge.no_edge_required(x, y):
                    continue
                shared = [v for v in g.neighbors(y) if g.undirected(v, y) and g.adjacent(v, x)]
                for k in range(len(shared) + 1):
                    for moved in combinations(shared, k):
                        kept = [v for v in shared if v not in moved]
                        if any(not g.adjacent(a, b) for a, b in combinations(kept, 2)):
                            continue
                        base = frozenset(kept) | frozenset(g.parents(y)) - {x}
                        gain = score.local(y, base) - score.local(y, base | {x})
                        if gain < -1e-9 and (best is None or (gain, x, y, moved) < best):
                            best = (gain, x, y, moved)
        if best is None:
            return g
        _, x, y, moved = best
        g = g.copy()
        g.remove(x, y)
        for v in moved:
            g.orient(y, v)
            if g.undirected(x, v):
                g.orient(x, v)
        g = cpdag(extension(g))


def boss(data: Data, num_starts: int = 3, penalty: float = 2.0, knowledge: Knowledge | None = None, seed: int = 0) -> Graph:
    """Best-order score search and backward sweeps over equivalence classes in turn; the best of several random starts.

    With tiers or required edges, which a sweep may break, there is the order search alone.
    """
    orders = Orders(DegenerateGaussian(data, penalty), knowledge)
    free = not (knowledge and (knowledge.tiers or knowledge.required or knowledge.forbidden))
    found = []
    for i in range(num_starts):
        order = best_moves(orders, orders.start(random.Random(f"{seed}-{i}")))
        while free:
            swept = backward(orders.score, orders.graph(order, "BOSS", penalty), knowledge).copy(ambiguous=set())
            new = best_moves(orders, extension(swept).order())
            if orders.of(new)[0] >= orders.of(order)[0] - 1e-9:
                break
            order = new
        found.append(order)
    return orders.graph(min(found, key=lambda o: (orders.of(o)[0], sum(map(len, orders.of(o)[1].values())), o)), "BOSS", penalty)


def tucked(order: list[str], x: str, y: str, parents: dict) -> list[str]:
    """y and its ancestors from x on move before x."""
    i, j = order.index(x), order.index(y)
    up, todo = {y}, [y]
    while todo:
        for w in parents[todo.pop()]:
            if w not in up:
                up.add(w)
                todo.append(w)
    part = order[i : j + 1]
    return order[:i] + [v for v in part if v in up and v != x] + [x] + [v for v in part if v not in up and v != x] + order[j + 1 :]


def grasp_search(orders: Orders, order: list[str], depth: int, tier: int) -> list[str]:
    """Depth-first over tucks of covered (tier 0), singular (1) or any (2) edges, through orders that score alike."""
    best = orders.of(order)[0]

    def tuckable(parents, x, y) -> bool:
        if tier == 0:
            return parents[y] - {x} == parents[x]
        return tier == 2 or not any(w != x and reaches(parents, x, w) for w in parents[y])

    def reaches(parents, a, b) -> bool:
        seen, todo = set(), [b]
        while todo:
            for w in parents[todo.pop()]:
                if w == a:
                    return True
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return False

    def visit(order, left, seen):
        score, parents = orders.of(order)
        for y in order:
            for x in sorted(parents[y]):
                if not tuckable(parents, x, y):
                    continue
                new = tucked(order, x, y, parents)
                if tuple(new) in seen or not orders.allowed(new):
                    continue
                s = orders.of(new)[0]
                if s < score - 1e-9:
                    return new
                if left > 1 and abs(s - score) <= 1e-9 and (got := visit(new, left - 1, seen | {tuple(new)})) and orders.of(got)[0] < score - 1e-9:
                    return got
        return None

    while (new := visit(order, depth, {tuple(order)})) and orders.of(new)[0] < best - 1e-9:
        order, best = new, orders.of(new)[0]
    return order


def grasp(data: Data, depth: int = 2, num_starts: int = 3, penalty: float = 2.0, boss_init: bool = False, knowledge: Knowledge | None = None, seed: int = 0, min_degree: bool = False) -> Graph:
    """Greedy relaxations of the sparsest permutation; tier 0 goes at least 4 deep."""
    orders, found = Orders(DegenerateGaussian(data, penalty), knowledge), []
    for i in range(num_starts):
        order = orders.start(random.Random(f"{seed}-{i}"), min_degree)
        if boss_init:
            order = best_moves(orders, order)
        for tier in (0, 1, 2):
            order = grasp_search(orders, order, max(4, depth) if tier == 0 else depth, tier)
        found.append(order)
    return orders.graph(min(found, key=lambda o: (orders.of(o)[0], sum(map(len, orders.of(o)[1].values())), o)), "GRaSP", penalty)
