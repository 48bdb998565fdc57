"""Texts that say what a path, a cross-validation, StARS or StEPS chose."""

from __future__ import annotations

from statistics import fmean

from dagwright.plans.graph import Graph


def titled(title: str, graph: Graph, *facts: str) -> str:
    return "\n".join([f"{title}:", *(f"  {x}" for x in facts), "", str(graph)])


def path_text(result: dict) -> str:
    """The graphs of least BIC and least AIC of a penalty path, with their places in it, from 1."""
    place = lambda k: min(range(len(result["rows"])), key=lambda i: result["rows"][i][k]) + 1
    return "\n\n".join(titled(f"Minimum {k} graph", result[k.lower()], f"Index: {place(k)}") for k in ("BIC", "AIC"))


def cv_text(result: dict) -> str:
    """The graph of the least mean loss and that within one deviation of it, with the mean sizes of their Markov blankets."""
    from dagwright.plans.resample import one_se

    rows = result["rows"]
    least = min(range(len(rows)), key=lambda i: rows[i]["mean"])
    blanket = lambda g: f"Average Markov Blanket Size: {fmean(len(g.markov_blanket(v)) for v in g.nodes)}"
    chosen = (("Minimum cross-validation loss graph", "min", least), ("Graph within one deviation of the minimum cross-validation loss", "1se", one_se(rows)))
    return "\n\n".join(titled(title, result[k], f"Index: {i + 1}", blanket(result[k])) for title, k, i in chosen)


def stars_text(result: dict) -> str:
    return titled("StARS selected graph", result["graph"], f"alpha: {result['alpha']}")


def steps_text(result: dict) -> str:
    return titled("StEPS selected graph", result["graph"], f"lambda: {result['lambda']}") + f"\n\nStARS selected lambda: {result['stars']}"
