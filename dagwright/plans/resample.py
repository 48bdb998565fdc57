"""Subsamples and folds by ranks of hashed rows; bootstrap, StARS, StEPS and cross-validation."""

from __future__ import annotations

import math
import random
import re
import statistics

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagwright.functions.regression import cox_loglik, logistic_batch, multinomial_loglik, ols
from dagwright.operators.dataset import Data, draw_keys
from dagwright.operators.graph_frames import ensemble
from dagwright.operators.independence import DataTest
from dagwright.plans.constraint import fci_stable, pc_stable, skeleton_of
from dagwright.plans.graph import Graph
from dagwright.plans.mgm import Mgm, grid, triple

#: Variation that a subsample needs: variance of a standardised column, rows of a level of the whole, events.
SUBSAMPLE = (1e-5, 3, 5)


def subsample_size(n: int) -> int:
    size = math.floor(10 * math.sqrt(n))
    return size if size < n else 3 * n // 4


def poisson_cuts(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... as far as they differ from 1."""
    total, term, cuts = 0.0, math.exp(-rate), []
    while total < 1 - 1e-15 and len(cuts) < 200:
        total += term
        cuts.append(min(total, 1.0))
        term *= rate / len(cuts)
    return cuts


def subsample(data: Data, size: int, seed: int, i: int, replace: bool = False) -> Data:
    """`size` of the rows, those of the least hashes; with replacement each row comes as often as a Poisson draw by its hash says."""
    if not replace:
        return data.part(0, size, seed, i, least=SUBSAMPLE)
    cuts = poisson_cuts(size / data.n)
    if data.local is not None:
        u = (draw_keys(data.keys, seed, i).view(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
        return data.of_rows(np.repeat(np.arange(data.n), np.searchsorted(cuts, u, side="right")), SUBSAMPLE)
    # repeated rows are told apart by where they are read
    h = F.xxhash64(data.row_key(), F.lit(seed).cast("long"), F.lit(i).cast("long"), F.monotonically_increasing_id())
    u = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    times = sum((u >= c).cast("int") for c in cuts)
    df = data.df.withColumn("_k", times).where("_k > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")
    return Data(df, check=False, local_cells=data.local_cells, like=data).checked(SUBSAMPLE)


def draws(data: Data, number: int, size: int | None, seed: int, replace: bool = False, leave_one_out: bool = False, attempts: int = 50) -> list[Data]:
    """Data sets of subsamples, those without enough variation drawn again; or the data without each of their rows."""
    if leave_one_out:
        return [data.part(i, i + 1, seed, inside=False) for i in range(data.n)]
    if size is not None and not 1 < size < data.n + replace:
        raise ValueError(f"a subsample of {data.n} rows cannot have {size}")
    out, i = [], 0
    while len(out) < number:
        if i >= number + attempts:
            raise ValueError("too many subsamples lack variation")
        try:
            out.append(subsample(data, size or subsample_size(data.n), seed, i, replace))
        except ValueError:
            pass
        i += 1
    return out


def learner(graph: Graph):
    """What learned a graph, by its algorithm's name and parameters: Data -> Graph."""
    from dagwright.plans.coxmgm import coxmgm
    from dagwright.plans.score import boss, grasp

    name, params = graph.algorithm or "", graph.params or {}
    found = re.fullmatch(r"(?:(MGM|CoxMGM)-)?(PC|FCI)-Stable \((\w+)\)", name)
    undirected = {"MGM": lambda d: Mgm(d).learn(triple(params["lambda"])).graph, "CoxMGM": lambda d: coxmgm(d, params["lambda"])}
    if found:
        first, search, rule = found.groups()
        run = pc_stable if search == "PC" else fci_stable
        return lambda d: run(d, initial=undirected[first](d) if first else None, rule=rule, alpha=params["alpha"], fdr=params.get("fdr", False))
    if name in undirected:
        return undirected[name]
    if name in ("BOSS", "GRaSP"):
        return lambda d: (boss if name == "BOSS" else grasp)(d, penalty=params["penalty"])
    raise ValueError(f"no search is called {name!r}")


def bootstrap(data: Data, learn, number: int = 20, replace: bool = False, seed: int = 0) -> tuple[Graph, DataFrame]:
    """learn(Data) -> Graph, or what learned the graph `learn`, over replicates; the ensemble graph and the frequencies of each pair's edge kinds."""
    spark = data.spark
    if isinstance(learn, Graph):
        learn = learner(learn)
    size = data.n if replace else math.ceil(0.632 * data.n)
    graphs = [learn(d) for d in draws(data, number, size, seed, replace)]
    rows = [(i, *e) for i, g in enumerate(graphs) for e in g.edges()]
    table = ensemble(spark.createDataFrame(rows, "boot int, node1 string, ep1 string, ep2 string, node2 string"), number).orderBy("none", "var1", "var2")
    g = Graph(data.names(), graphs[0].type, algorithm=graphs[0].algorithm)
    marks = {"---": "--", "-->": "->", "<--": ">-", "<->": ">>", "o->": "o>", "<-o": ">o", "o-o": "oo"}
    for r in table.collect():  # a row for each pair of variables at most
        if r.interaction != "none":
            g.add(r.var1, r.var2, *marks[r.interaction])
    g.stabilities = table
    return g, table


def instability(graphs: list[Graph], pairs) -> float | None:
    """Mean of 2 f (1 - f) over pairs, f being the part of graphs that have the edge."""
    f = [sum(g.adjacent(a, b) for g in graphs) / len(graphs) for a, b in pairs]
    return sum(2 * x * (1 - x) for x in f) / len(f) if f else None


def stars(data: Data, alphas: list[float], gamma: float = 0.01, number: int = 20, seed: int = 0, search: str = "pc", size: int | None = None, leave_one_out: bool = False, initial: Graph | None = None) -> dict:
    """The largest alpha before the running maximum of the skeletons' instability exceeds gamma, and its graph."""
    names = sorted(data.names())
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    parts, chosen, top, rows = draws(data, number, size, seed, leave_one_out=leave_one_out), None, 0.0, []
    for alpha in sorted(alphas):
        top = max(top, instability([skeleton_of(d, alpha, initial) for d in parts], pairs) or 0.0)
        rows.append({"alpha": alpha, "instability": top})
        if top <= gamma or chosen is None:
            chosen = alpha
    run = pc_stable if search == "pc" else fci_stable
    return {"alpha": chosen, "rows": rows, "graph": run(data, alpha=chosen, initial=initial)}


def steps(data: Data, lambdas: list[float] | None = None, n_lambda: int = 20, gamma: float = 0.05, number: int = 20, seed: int = 0, size: int | None = None, leave_one_out: bool = False) -> dict:
    """A penalty for each class of pairs (continuous, mixed, discrete): the last, from the largest down, before instability reaches gamma."""
    kind = {v.name: v.kind == "discrete" for v in data.variables}
    names = sorted(kind)
    classes = [[(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if kind[a] + kind[b] == c] for c in range(3)]
    models = [Mgm(d) for d in draws(data, number, size, seed, leave_one_out=leave_one_out)]
    start, chosen, top, rows, one = [None] * len(models), [None] * 3, [0.0] * 3, [], None
    for lam in sorted(lambdas or grid(Mgm(data), n_lambda), reverse=True):
        fits = [m.learn(triple(lam), s) for m, s in zip(models, start, strict=True)]
        start = [f.params for f in fits]
        graphs = [f.graph for f in fits]
        for c in range(3):
            d = instability(graphs, classes[c])  # a class without pairs has none
            top[c] = max(top[c], d or 0.0)
            if chosen[c] is None or top[c] < gamma:
                chosen[c] = lam
        whole = instability(graphs, sum(classes, []))
        if one is None or (whole or 0) < gamma:
            one = lam
        rows.append({"lambda": lam, "instability": list(top), "all": whole})
        if all(t >= gamma or not classes[c] for c, t in enumerate(top)):
            break
    return {"lambda": chosen, "stars": one, "rows": rows, "graph": Mgm(data).learn(tuple(chosen)).graph}


def split(data: Data, folds: int | Column, seed: int = 0) -> list[tuple[Data, Data]]:
    """Training and test rows of each fold, with the levels of the whole.

    Folds are of equal size but for one row, by the rows' hashes, or what a column of whole numbers from 1
    says, which must be of about equal size.
    """
    if isinstance(folds, int):
        cuts = [data.n * k // folds for k in range(folds + 1)]
        return [(data.part(a, b, seed, inside=False), data.part(a, b, seed)) for a, b in zip(cuts, cuts[1:], strict=False)]
    named = data.df.withColumn("_fold", folds.cast("int"))
    sizes = {r["_fold"]: r["count"] for r in named.groupBy("_fold").count().collect()}  # a row for each fold
    if sorted(sizes, key=str) != sorted(range(1, len(sizes) + 1), key=str) or max(sizes.values()) - min(sizes.values()) > 0.05 * data.n:
        raise ValueError("folds are whole numbers from 1, each of about as many rows")
    part = lambda c: Data(named.where(c).drop("_fold"), check=False, local_cells=data.local_cells, like=data)
    return [(part(F.col("_fold") != k), part(F.col("_fold") == k)) for k in sorted(sizes)]


def one_se(rows: list[dict]) -> int:
    """Index of the first row, in order, whose mean is under the least mean plus its deviation."""
    best = min(rows, key=lambda r: r["mean"])
    return next(i for i, r in enumerate(rows) if r["mean"] <= best["mean"] + best["se"])


def summary(values: list[float]) -> dict:
    """Mean and standard deviation over folds (`se` is the deviation itself); a fold whose fit failed makes both infinite."""
    if math.inf in values:
        return {"mean": math.inf, "se": math.inf}
    return {"mean": statistics.fmean(values), "se": statistics.stdev(values) if len(values) > 1 else 0.0}


def mgm_cv(data: Data, lambdas: list[float] | None = None, n_lambda: int = 20, folds: int | Column = 5, seed: int = 0) -> dict:
    lams = sorted(lambdas or grid(Mgm(data), n_lambda), reverse=True)
    losses = {lam: [] for lam in lams}
    for train, test in split(data, folds, seed):
        model, start = Mgm(train), None
        for lam in lams:
            got = model.learn(triple(lam), start)
            start = got.params
            losses[lam].append(model.smooth(start, test, slope=False)[0])
    rows = [{"lambda": lam} | summary(losses[lam]) for lam in lams]
    best, se = min(rows, key=lambda r: r["mean"])["lambda"], rows[one_se(rows)]["lambda"]
    return {"rows": rows, "min": Mgm(data).learn(triple(best)).graph, "1se": Mgm(data).learn(triple(se)).graph}


def held_out_loglik(train: Data, test: Data, target: str, given: list[str]) -> float:
    """The log-likelihood of test rows of a variable given others, by the fit on training rows; -inf where that fails.

    Of a continuous variable up to a constant, the variance being that of the test residuals.
    """
    xs, own = [c for v in given for c in train.regressors[v]], train.columns[target]
    try:
        if train.kind(target) == "continuous":
            b = ols(train.gram(), train.n, own[0], xs).coef
            cols = [0, *(x + 1 for x in xs)]
            g = test.gram()
            rss = float(g[own[0] + 1, own[0] + 1] - 2 * b @ g[cols, own[0] + 1] + b @ g[np.ix_(cols, cols)] @ b)
            return -test.n / 2 * math.log(max(rss, 1e-300) / test.n)
        if train.kind(target) == "discrete":
            fits = logistic_batch(train, [(c, xs) for c in own])
            if None in fits:
                return -math.inf
            return float(multinomial_loglik(test, [(own, [xs] * len(own), [f[0] for f in fits])])[0])
        b = train.cox(target, xs).coef
        t, e, s = test.survival(target)
        return cox_loglik(t, e, test.local[:, xs] @ b, s)
    except (np.linalg.LinAlgError, ArithmeticError):
        return -math.inf


def random_points(number: int, lambdas: list[float], alphas: list[float], seed: int) -> list[tuple[float, float]]:
    """Pairs of a penalty and an alpha, uniform over the ranges of both."""
    rng = random.Random(seed)
    return [(rng.uniform(min(lambdas), max(lambdas)), rng.uniform(min(alphas), max(alphas))) for _ in range(number)]


def search_cv(data: Data, alphas: list[float] = (0.001, 0.01, 0.05, 0.1), rules: list[str] = ("majority",), lambdas: list[float] | None = None, folds: int | Column = 5, seed: int = 0, search: str = "pc", number: int | None = None) -> dict:
    """PC or FCI, on an MGM skeleton for each penalty if there are any: mean loss of test rows, each node given its Markov blanket.

    Graphs and fits come from training rows alone. With `number`, as many random pairs within the ranges
    of lambdas and alphas are tried in place of the grid.
    """
    run = pc_stable if search == "pc" else fci_stable
    points = random_points(number, lambdas, alphas, seed) if number and lambdas else [(lam, a) for lam in lambdas or [None] for a in alphas]
    scores: dict = {}
    for train, test in split(data, folds, seed):
        known, skeletons, test_of = {}, {}, DataTest(train)

        def loss(v, blanket, known=known, train=train, test=test):
            if (v, blanket) not in known:
                known[v, blanket] = -held_out_loglik(train, test, v, sorted(blanket)) / max(1, test.n)
            return known[v, blanket]

        for lam, alpha in points:
            if lam is not None and lam not in skeletons:
                skeletons[lam] = Mgm(train).learn(triple(lam)).graph
            for rule, g in zip(rules, run(test_of, initial=skeletons.get(lam), rule=list(rules), alpha=alpha), strict=True):
                blankets = {v: frozenset(g.markov_blanket(v)) for v in g.nodes}
                scores.setdefault((lam, alpha, rule), []).append((sum(loss(v, b) for v, b in blankets.items()), sum(map(len, blankets.values()))))
    rows = [{"lambda": k[0], "alpha": k[1], "orientRule": k[2], "size": statistics.fmean(z for _, z in v)} | summary([s for s, _ in v]) for k, v in scores.items()]
    rows.sort(key=lambda r: (r["size"], r["alpha"], -(r["lambda"] or 0), r["orientRule"]))
    learn = lambda r: run(data, initial=None if r["lambda"] is None else Mgm(data).learn(triple(r["lambda"])).graph, rule=r["orientRule"], alpha=r["alpha"])
    best, se = min(rows, key=lambda r: r["mean"]), rows[one_se(rows)]
    graph = learn(best)
    return {"rows": rows, "min": graph, "1se": graph if se is best else learn(se)}
