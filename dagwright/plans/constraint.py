"""Constraint-based search: the stable adjacency search, PC-Stable and FCI-Stable.

Each depth is one batch of tests against one snapshot of the adjacencies, so the order of variables
does not matter. Of several separating sets the one with the largest p stays, then the smaller, then the
first by name.
"""

from __future__ import annotations

from collections import deque
from itertools import combinations

from dagwright.operators.dataset import Data
from dagwright.operators.independence import DataTest
from dagwright.plans.graph import ARROW, CIRCLE, CPDAG, PAG, Graph
from dagwright.plans.knowledge import Knowledge
from dagwright.plans.orient import PagRules, meek, orient_known

RULES = ("majority", "maxp", "conservative", "sepsets")


def pair(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a < b else (b, a)


class Sepsets(dict):
    """Pair to (p, set)."""

    def offer(self, a: str, b: str, z: tuple[str, ...], p: float) -> None:
        key = pair(a, b)
        if key not in self or (-p, len(z), z) < (-self[key][0], len(self[key][1]), self[key][1]):
            self[key] = (p, tuple(z))

    def of(self, a: str, b: str):
        got = self.get(pair(a, b))
        return None if got is None else set(got[1])


def possible_parents(g: Graph, x: str, y: str, knowledge: Knowledge | None) -> list[str]:
    return [z for z in g.neighbors(x) if z != y and not (knowledge and (knowledge.is_forbidden(z, x) or knowledge.is_required(x, z)))]


def step_up(p: dict, alpha: float, total: int, dependent: bool) -> set:
    """Pairs that the step-up rule does not reject: Benjamini-Hochberg, or with dependent tests Benjamini-Yekutieli."""
    scale = sum(1 / i for i in range(1, total + 1)) if dependent else 1.0
    ranked = sorted(p.items(), key=lambda x: (x[1], x[0]))
    last = max((i for i, (_, v) in enumerate(ranked, 1) if v <= alpha * i / (total * scale)), default=0)
    return {k for k, _ in ranked[last:]}


def adjacency_search(test, alpha: float, knowledge: Knowledge | None = None, initial: Graph | None = None, depth: int = -1, fdr: bool = False) -> tuple[Graph, Sepsets]:
    nodes = sorted(test.nodes())
    known = knowledge or Knowledge()
    known.check(nodes)
    pairs = [p for p in combinations(nodes, 2) if initial is None or initial.adjacent(*p)]
    g, seps, most = Graph(nodes), Sepsets(), {}
    for (a, b), p in zip(pairs, test.p_values([(a, b, ()) for a, b in pairs]), strict=True):
        keep = not known.no_edge_required(a, b)
        if (p <= alpha or keep) and not (known.is_forbidden(a, b) and known.is_forbidden(b, a)):
            g.add(a, b)
        if p > alpha:
            seps.offer(a, b, (), p)
        most[a, b] = p

    def false_discoveries(dependent: bool) -> None:
        if fdr:
            for a, b in step_up({k: v for k, v in most.items()}, alpha, len(pairs) if initial is None else max(len(pairs), 1), dependent):
                if g.adjacent(a, b) and known.no_edge_required(a, b):
                    g.remove(a, b)

    false_discoveries(initial is not None)
    d = 1
    while (depth < 0 or d <= depth) and max((len(g.near[v]) - 1 for v in nodes), default=0) >= d:
        tests = sorted({(*pair(x, y), z) for x in nodes for y in g.neighbors(x) if known.no_edge_required(x, y) for z in combinations(possible_parents(g, x, y, knowledge), d)})
        gone = set()
        for (x, y, z), p in zip(tests, test.p_values(tests), strict=True):
            most[x, y] = max(most.get((x, y), 0.0), p)
            if p > alpha:
                seps.offer(x, y, z, p)
                gone.add((x, y))
        for x, y in gone:
            g.remove(x, y)
        false_discoveries(True)
        d += 1
    return g, seps


def unshielded(g: Graph) -> list[tuple[str, str, str]]:
    return [(a, b, c) for b in sorted(g.nodes) for a, c in combinations(g.neighbors(b), 2) if not g.adjacent(a, c)]


def judge_triples(test, g: Graph, seps: Sepsets, rule: str, alpha: float, knowledge: Knowledge | None, depth: int = -1) -> tuple[list, set]:
    """Colliders, in ascending order of confidence, and ambiguous triples, by an orientation rule."""
    triples = unshielded(g)
    if rule == "sepsets":
        return [t for t in triples if (z := seps.of(t[0], t[2])) is not None and t[1] not in z], set()
    if rule not in RULES:
        raise ValueError(f"orientation rules are {RULES}")
    sets = {}
    for a, _, c in triples:
        if (a, c) not in sets:
            own = set()
            for x, y in ((a, c), (c, a)):
                z = possible_parents(g, x, y, knowledge)
                for k in range((len(z) if depth < 0 else min(depth, len(z))) + 1):
                    own |= set(combinations(z, k))
            sets[a, c] = sorted(own, key=lambda z: (len(z), z))
    asked = [(a, c, z) for (a, c), zs in sets.items() for z in zs]
    p = dict(zip(asked, test.p_values(asked), strict=True))
    colliders, ambiguous = [], set()
    for a, b, c in triples:
        found = [(z, p[a, c, z]) for z in sets[a, c] if p[a, c, z] > alpha]
        inside, outside = sum(b in z for z, _ in found), sum(b not in z for z, _ in found)
        best = max(found, key=lambda x: (x[1], -len(x[0])), default=None)
        if rule == "maxp":
            best = best or max(((z, p[a, c, z]) for z in sets[a, c]), key=lambda x: x[1])
            if b not in best[0]:
                colliders.append((best[1], (a, b, c)))
        elif rule == "majority":
            if outside > inside:
                colliders.append((outside / (outside + inside), (a, b, c)))
            elif outside == inside:
                ambiguous.add((a, b, c))
        elif outside and not inside:
            colliders.append((best[1], (a, b, c)))
        elif outside or not inside:
            ambiguous.add((a, b, c))
    return [t for _, t in sorted(colliders)], ambiguous


def orient_pc(test, skeleton: Graph, seps: Sepsets, rule: str, alpha: float, knowledge: Knowledge | None) -> Graph:
    g = skeleton.copy(type=CPDAG, algorithm=f"PC-Stable ({rule})", params={"alpha": alpha})
    colliders, g.ambiguous = judge_triples(test, skeleton, seps, rule, alpha, knowledge)
    orient_known(g, knowledge)
    for a, b, c in colliders:
        if not (knowledge and (knowledge.is_forbidden(a, b) or knowledge.is_forbidden(c, b) or knowledge.is_required(b, a) or knowledge.is_required(b, c))):
            g.orient(a, b)
            g.orient(c, b)
    meek(g, knowledge)
    return g


def pc_stable(data, initial: Graph | None = None, knowledge: Knowledge | None = None, rule: str | list[str] = "majority", alpha: float = 0.05, fdr: bool = False, depth: int = -1):
    """PC-Stable over a Data set or a test object; several rules share one adjacency search."""
    test = data if hasattr(data, "p_values") else DataTest(data)
    g, seps = adjacency_search(test, alpha, knowledge, initial, depth, fdr)
    out = [orient_pc(test, g, seps, r, alpha, knowledge) for r in ([rule] if isinstance(rule, str) else rule)]
    return out[0] if isinstance(rule, str) else out


def possible_d_sep(g: Graph, x: str, y: str) -> list[str]:
    """Nodes that x reaches by paths whose every inner node is a collider or in a triangle with its neighbours."""
    seen, todo, out = set(), [(x, v) for v in g.neighbors(x)], set()
    while todo:
        a, b = todo.pop()
        if (a, b) in seen:
            continue
        seen.add((a, b))
        out.add(b)
        for c in g.neighbors(b):
            if c != a and (g.adjacent(a, c) or g.marks[a, b] == ARROW == g.marks[c, b]):
                todo.append((b, c))
    return sorted(out - {x, y})


def least_separating(test, a: str, b: str, z: tuple[str, ...], alpha: float) -> tuple[tuple[str, ...], float]:
    """The smallest part of a separating set that separates as well, of several the one of the largest p."""
    for k in range(len(z) + 1):
        sets = list(combinations(z, k))
        found = [(p, s) for s, p in zip(sets, test.p_values([(a, b, s) for s in sets]), strict=True) if p > alpha]
        if found:
            p, s = max(found, key=lambda x: x[0])
            return s, p
    return z, 0.0


def rfci_prune(test, g: Graph, seps: Sepsets, alpha: float, knowledge: Knowledge | None = None) -> None:
    """Removes edges of unshielded triples whose ends are independent given the outer pair's separating set (Colombo et al. 2012).

    A triple a - b - c is a sound collider or non-collider only if b depends on a and on c given that set
    without b; each edge that goes may leave new triples behind.
    """
    todo = deque(unshielded(g))
    while todo:
        a, b, c = todo.popleft()
        z = seps.of(a, c)
        if z is None or g.adjacent(a, c) or not (g.adjacent(a, b) and g.adjacent(b, c)):
            continue
        z = tuple(sorted(z - {b}))
        for x, p in zip((a, c), test.p_values([(a, b, z), (c, b, z)]), strict=True):
            if p <= alpha or knowledge and not knowledge.no_edge_required(x, b):
                continue
            least, p = least_separating(test, x, b, z, alpha)
            seps.offer(x, b, least, p)
            g.remove(x, b)
            todo.extend((x, v, b) for v in g.neighbors(x) if g.adjacent(v, b))


def circles(g: Graph) -> Graph:
    return Graph(list(g.nodes), PAG, dict.fromkeys(g.marks, CIRCLE))


def orient_colliders(g: Graph, rules: PagRules, colliders: list) -> None:
    rules.known()
    for a, b, c in colliders:
        if rules.allowed(a, b) and rules.allowed(c, b):
            g.marks[a, b] = g.marks[c, b] = ARROW


def fci_stable(data, initial: Graph | None = None, knowledge: Knowledge | None = None, rule: str | list[str] = "majority", alpha: float = 0.05, fdr: bool = False, depth: int = -1, possible_dsep: bool = True, complete_rules: bool = False):
    """FCI-Stable: adjacency search, pruning as in RFCI, removal within possible d-separating sets, colliders, rules R1 to R4 (R10)."""
    test = data if hasattr(data, "p_values") else DataTest(data)
    g, seps = adjacency_search(test, alpha, knowledge, initial, depth, fdr)
    apart = lambda x, y, z: test.p_values([(x, y, tuple(z))])[0] > alpha
    rfci_prune(test, g, seps, alpha, knowledge)
    if possible_dsep:
        shape = circles(g)
        orient_colliders(shape, PagRules(shape, seps.of, apart, knowledge), judge_triples(test, g, seps, "conservative", alpha, knowledge, depth)[0])
        around = {(a, b): (possible_d_sep(shape, a, b), possible_d_sep(shape, b, a)) for a, b in combinations(sorted(g.nodes), 2) if g.adjacent(a, b) and not (knowledge and not knowledge.no_edge_required(a, b))}
        size = 1
        while around and any(len(z) >= size for zs in around.values() for z in zs) and (depth < 0 or size <= depth):
            tests = sorted({(a, b, z) for (a, b), zs in around.items() for own in zs for z in combinations(own, size)})
            for (a, b, z), p in zip(tests, test.p_values(tests), strict=True):
                if p > alpha:
                    seps.offer(a, b, z, p)
                    around.pop((a, b), None)
                    if g.adjacent(a, b):
                        g.remove(a, b)
            size += 1
    out = []
    for r in [rule] if isinstance(rule, str) else rule:
        pag = circles(g).copy(algorithm=f"FCI-Stable ({r})", params={"alpha": alpha})
        colliders, pag.ambiguous = judge_triples(test, g, seps, r, alpha, knowledge, depth)
        rules = PagRules(pag, seps.of, apart, knowledge)
        orient_colliders(pag, rules, colliders)
        rules.run(complete_rules)
        out.append(pag)
    return out[0] if isinstance(rule, str) else out


def pag(dag: Graph, latent: list[str] | None = None) -> Graph:
    """The partial ancestral graph of a directed graph over its nodes but `latent`: separating sets come from ancestors."""
    from dagwright.operators.independence import GraphTest

    observed = sorted(set(dag.nodes) - set(latent or ()))
    test, g, seps = GraphTest(dag, observed), Graph(observed, PAG), {}
    for a, b in combinations(observed, 2):
        z = tuple(sorted((dag.ancestors(a) | dag.ancestors(b)) & set(observed) - {a, b}))
        if dag.d_separated(a, b, z):
            seps[a, b] = set(z)
        else:
            g.add(a, b, CIRCLE, CIRCLE)
    rules = PagRules(g, lambda a, b: seps.get(pair(a, b)), lambda a, b, z: test.p_values([(a, b, z)])[0] > 0)
    orient_colliders(g, rules, [(a, b, c) for a, b, c in unshielded(g) if b not in seps[pair(a, c)]])
    rules.run(True)
    return g


def skeleton_of(data: Data, alpha: float, initial: Graph | None = None) -> Graph:
    return adjacency_search(DataTest(data), alpha, initial=initial)[0]
