"""Graph files: the full text format, and tab-separated interactions."""

from __future__ import annotations

import re

from dagwright.plans.graph import Graph, edge_of, graph_of

#: Section heads of the text format, and interaction names of .sif files by marks. (Fixed values.)
NODES, EDGES, AMBIGUOUS = "Graph Nodes:", "Graph Edges:", "Ambiguous triples"
SIF = {("-", "-"): "undir", ("-", ">"): "dir", (">", ">"): "bidir", ("o", ">"): "ca", ("o", "o"): "cc"}


def save_graph(g: Graph, path: str) -> str:
    """Writes a .txt or .sif file, .txt where the name ends otherwise; returns its path."""
    if path.endswith(".sif"):
        text = "".join(f"{a}\t{SIF[x, y]}\t{b}\n" for a, x, y, b in g.edges())
    else:
        path = path if path.endswith(".txt") else path + ".txt"
        parts = [NODES, ",".join(g.nodes), "", EDGES, *(f"{i}. {x}" for i, x in enumerate(g.lines(), 1)), "", f"Algorithm: {g.algorithm}"]
        for name in ("lambda", "alpha", "penalty"):
            if name in g.params:
                v = g.params[name]
                parts.append(f"{name.capitalize()}: {' '.join(map(str, v if isinstance(v, (list, tuple)) else [v]))}")
        parts.append(f"Type: {g.type}")
        if g.ambiguous:
            parts += ["", f"{AMBIGUOUS}:", *(",".join(t) for t in sorted(g.ambiguous))]
        text = "\n".join(parts) + "\n"
    with open(path, "w") as f:
        f.write(text)
    return path


def load_graph(path: str) -> Graph:
    with open(path) as f:
        lines = [x.strip() for x in f]
    at = lines.index(NODES)
    g = graph_of([x for x in re.split("[;,]", lines[at + 1]) if x], [])
    section = ""
    for line in lines[at + 2 :]:
        if line.startswith((EDGES, AMBIGUOUS)):
            section = line.rstrip(":")
        elif m := re.fullmatch(r"\d+\. (.+)", line):
            a, x, y, b = edge_of(m[1])
            g.add(a, b, x, y)
        elif m := re.fullmatch(r"(Algorithm|Lambda|Alpha|Penalty|Type): ?(.*)", line):
            if m[1] == "Algorithm":
                g.algorithm = m[2]
            elif m[1] == "Type":
                g.type = m[2]
            else:
                v = [float(x) for x in m[2].split()]
                g.params[m[1].lower()] = v if m[1] == "Lambda" else v[0]
        elif section == AMBIGUOUS and line.count(",") == 2:
            g.ambiguous.add(tuple(line.split(",")))
    return g
