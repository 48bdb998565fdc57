"""Graphs over variables: marks at both ends of each edge, algebra, and conversion to DataFrames."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Marks at an end of an edge.
TAIL, ARROW, CIRCLE = "-", ">", "o"
#: Text of an edge a op b by the marks at a and b; graph types. (Fixed values.)
OPS = {(TAIL, TAIL): "---", (TAIL, ARROW): "-->", (ARROW, ARROW): "<->", (CIRCLE, ARROW): "o->", (CIRCLE, CIRCLE): "o-o"}
UNDIRECTED, DAG = "undirected", "directed acyclic graph"
CPDAG, PAG = "completed partially directed acyclic graph", "partial ancestral graph"


@dataclasses.dataclass
class Graph:
    """marks[a, b] is the mark at b of the edge between a and b; it is there for (b, a) too."""

    nodes: list[str]
    type: str = UNDIRECTED
    marks: dict[tuple[str, str], str] = dataclasses.field(default_factory=dict)
    ambiguous: set[tuple[str, str, str]] = dataclasses.field(default_factory=set)
    algorithm: str = ""
    params: dict = dataclasses.field(default_factory=dict)
    stabilities: DataFrame | None = None

    def __post_init__(self):
        self.near = {v: set() for v in self.nodes}
        for a, b in self.marks:
            self.near[a].add(b)

    def copy(self, **changes) -> Graph:
        return dataclasses.replace(self, **{"nodes": list(self.nodes), "marks": dict(self.marks), "ambiguous": set(self.ambiguous), "params": dict(self.params)} | changes)

    def add(self, a: str, b: str, at_a: str = TAIL, at_b: str = TAIL) -> None:
        if a == b or a not in self.near or b not in self.near:
            raise ValueError(f"no edge {a}, {b} in this graph")
        self.marks[a, b], self.marks[b, a] = at_b, at_a
        self.near[a].add(b)
        self.near[b].add(a)

    def remove(self, a: str, b: str) -> None:
        for x, y in ((a, b), (b, a)):
            self.marks.pop((x, y), None)
            self.near[x].discard(y)

    def remove_node(self, v: str) -> None:
        for w in list(self.near[v]):
            self.remove(v, w)
        self.nodes.remove(v)
        del self.near[v]

    def subgraph(self, keep: Iterable[str]) -> Graph:
        keep = set(keep)
        return Graph([v for v in self.nodes if v in keep], self.type, {k: m for k, m in self.marks.items() if set(k) <= keep})

    def adjacent(self, a: str, b: str) -> bool:
        return b in self.near[a]

    def directed(self, a: str, b: str) -> bool:
        return self.marks.get((a, b)) == ARROW and self.marks.get((b, a)) == TAIL

    def undirected(self, a: str, b: str) -> bool:
        return self.marks.get((a, b)) == TAIL and self.marks.get((b, a)) == TAIL

    def orient(self, a: str, b: str) -> None:
        self.add(a, b, TAIL, ARROW)

    def parents(self, v: str) -> list[str]:
        return sorted(w for w in self.near[v] if self.directed(w, v))

    def children(self, v: str) -> list[str]:
        return sorted(w for w in self.near[v] if self.directed(v, w))

    def neighbors(self, v: str) -> list[str]:
        return sorted(self.near[v])

    def spouses(self, v: str) -> list[str]:
        return sorted(w for w in self.near[v] if self.marks[v, w] == ARROW == self.marks[w, v])

    def edges(self) -> list[tuple[str, str, str, str]]:
        """(node1, mark at it, mark at node2, node2), arrows to the right, equal marks by name, sorted."""
        out = []
        for a, b in self.marks:
            ma, mb = self.marks[b, a], self.marks[a, b]
            if (ma, mb) in OPS and (ma != mb or a < b):
                out.append((a, ma, mb, b))
        return sorted(out, key=lambda e: (e[0], e[3]))

    def lines(self) -> list[str]:
        return [f"{a} {OPS[x, y]} {b}" for a, x, y, b in self.edges()]

    def ancestors(self, v: str) -> set[str]:
        out, todo = {v}, [v]
        while todo:
            for w in self.parents(todo.pop()):
                if w not in out:
                    out.add(w)
                    todo.append(w)
        return out

    def cyclic_after(self, a: str, b: str) -> bool:
        """Whether a -> b would close a directed cycle."""
        return b in self.ancestors(a)

    def order(self) -> list[str]:
        """A causal order of a directed graph: parents first, then by name."""
        left, out = {v: len(self.parents(v)) for v in self.nodes}, []
        ready = sorted(v for v, k in left.items() if not k)
        while ready:
            v = ready.pop(0)
            out.append(v)
            for w in self.children(v):
                left[w] -= 1
                if not left[w]:
                    ready = sorted([*ready, w])
        if len(out) < len(self.nodes):
            raise ValueError("the graph has a directed cycle")
        return out

    def markov_blanket(self, v: str) -> list[str]:
        """Neighbours, parents of children, and through bidirected edges the districts of v and its children with their parents."""
        out = set(self.near[v])
        reach, todo = {v, *self.children(v)}, [v, *self.children(v)]
        while todo:
            for w in self.spouses(todo.pop()):
                if w not in reach:
                    reach.add(w)
                    todo.append(w)
        for w in reach:
            out |= {w, *self.parents(w)}
        return sorted(out - {v})

    def d_separated(self, a: str, b: str, given: Iterable[str]) -> bool:
        """In a directed graph: no active path, by reachability over (node, came from a child)."""
        given = set(given)
        up = set().union(*(self.ancestors(z) for z in given)) if given else set()
        seen, todo = set(), [(a, True)]
        while todo:
            v, from_child = todo.pop()
            if (v, from_child) in seen:
                continue
            seen.add((v, from_child))
            if v == b:
                return False
            if from_child and v not in given:
                todo += [(w, True) for w in self.parents(v)] + [(w, False) for w in self.children(v)]
            elif not from_child:
                if v not in given:
                    todo += [(w, False) for w in self.children(v)]
                if v in up:
                    todo += [(w, True) for w in self.parents(v)]
        return True

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edges(), "node1 string, ep1 string, ep2 string, node2 string")

    def blankets(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(v, self.markov_blanket(v), self.neighbors(v)) for v in self.nodes], "node string, markov_blanket array<string>, neighbors array<string>")

    def __str__(self) -> str:
        from collections import Counter

        kinds = Counter(OPS[x, y] for _, x, y, _ in self.edges())
        counts = ", ".join(f"{n} {op}" for op, n in sorted(kinds.items()))
        return "\n".join([f"Algorithm: {self.algorithm}", f"Type: {self.type}", f"Nodes: {len(self.nodes)}", f"Edges: {sum(kinds.values())} ({counts})", *(f"{k}: {v}" for k, v in self.params.items())])


def edge_of(line: str) -> tuple[str, str, str, str]:
    """(a, mark at a, mark at b, b) of `a op b`; `<--` is read too."""
    a, op, b = line.split()
    if op == "<--":
        return b, TAIL, ARROW, a
    for (x, y), text in OPS.items():
        if text == op:
            return a, x, y, b
    raise ValueError(f"no edge: {line}")


def graph_of(nodes: list[str], lines: Iterable[str], type: str = UNDIRECTED) -> Graph:
    g = Graph(list(nodes), type)
    for line in lines:
        a, x, y, b = edge_of(line)
        g.add(a, b, x, y)
    return g


def from_frame(df: DataFrame, nodes: list[str], type: str) -> Graph:
    """A graph of an edge frame; it has as many rows as edges."""
    g = Graph(list(nodes), type)
    for r in df.collect():
        g.add(r.node1, r.node2, r.ep1, r.ep2)
    return g


def from_matrix(adjacency, nodes: list[str], directed: bool = False) -> Graph:
    """adjacency[i][j] other than 0: nodes[j] -> nodes[i] if directed, else an edge from the upper triangle."""
    g = Graph(list(nodes), DAG if directed else UNDIRECTED)
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes):
            if adjacency[i][j]:
                if directed:
                    g.orient(b, a)
                elif i < j:
                    g.add(a, b)
    return g


def skeleton(g: Graph) -> Graph:
    return Graph(list(g.nodes), UNDIRECTED, dict.fromkeys(g.marks, TAIL))


def v_structures(g: Graph) -> list[tuple[str, str, str]]:
    return [(a, c, b) for c in g.nodes for a in g.parents(c) for b in g.parents(c) if a < b and not g.adjacent(a, b)]


def moral(g: Graph) -> Graph:
    out = skeleton(g)
    for a, _, b in v_structures(g):
        out.add(a, b)
    return out


def extension(g: Graph) -> Graph:
    """A directed acyclic graph of the class of a CPDAG (Dor and Tarsi 1992): sinks are taken away one by one."""
    out, left = g.copy(type=DAG), g.copy()
    while left.nodes:
        for v in sorted(left.nodes):
            flat = [w for w in left.neighbors(v) if left.undirected(v, w)]
            if not left.children(v) and all(w == u or left.adjacent(w, u) for w in flat for u in left.near[v]):
                break
        else:
            raise ValueError("the graph has no directed extension")
        for w in flat:
            out.orient(w, v)
        for w in left.neighbors(v):
            left.remove(v, w)
        left.nodes.remove(v)
        del left.near[v]
    return out


def cpdag(g: Graph) -> Graph:
    """The class of a directed acyclic graph: its v-structures, closed under the orientation rules."""
    from dagwright.plans.orient import meek

    out = skeleton(g).copy(type=CPDAG)
    for a, c, b in v_structures(g):
        out.orient(a, c)
        out.orient(b, c)
    meek(out)
    return out
