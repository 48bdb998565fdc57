"""Graph algebra and comparison on edge frames (node1, ep1, ep2, node2), as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagwright.plans.graph import CPDAG, PAG, UNDIRECTED, Graph

EDGE = ["node1", "ep1", "ep2", "node2"]


def canonical(edges: DataFrame) -> DataFrame:
    """Arrows to the right, equal marks by name, each edge once."""
    flip = ((F.col("ep1") == ">") & (F.col("ep2") != ">")) | ((F.col("ep1") == "o") & (F.col("ep2") == "-")) | ((F.col("ep1") == F.col("ep2")) & (F.col("node1") > F.col("node2")))
    pick = lambda a, b, name: F.when(flip, F.col(b)).otherwise(F.col(a)).alias(name)
    return edges.select(pick("node1", "node2", "node1"), pick("ep1", "ep2", "ep1"), pick("ep2", "ep1", "ep2"), pick("node2", "node1", "node2")).distinct()


def pairs(edges: DataFrame) -> DataFrame:
    """a < b and the marks at both."""
    first = F.col("node1") < F.col("node2")
    return edges.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"), F.when(first, F.col("ep1")).otherwise(F.col("ep2")).alias("ma"), F.when(first, F.col("ep2")).otherwise(F.col("ep1")).alias("mb"))


def both_ways(edges: DataFrame) -> DataFrame:
    """u, v and the marks at them, each edge from both ends."""
    return edges.select(F.col("node1").alias("u"), F.col("ep1").alias("mu"), F.col("ep2").alias("mv"), F.col("node2").alias("v")).union(edges.select("node2", "ep2", "ep1", "node1"))


def arrows(edges: DataFrame) -> DataFrame:
    return both_ways(edges).where("mu = '-' and mv = '>'").select(F.col("u").alias("parent"), F.col("v").alias("child"))


def skeleton(edges: DataFrame) -> DataFrame:
    return pairs(edges).select(F.col("a").alias("node1"), F.lit("-").alias("ep1"), F.lit("-").alias("ep2"), F.col("b").alias("node2")).distinct()


def v_structures(edges: DataFrame) -> DataFrame:
    """Unshielded colliders a -> c <- b, a < b."""
    into = arrows(edges)
    two = into.select(F.col("parent").alias("a"), "child").join(into.select(F.col("parent").alias("b"), "child"), "child").where("a < b")
    return two.join(pairs(edges).select("a", "b"), ["a", "b"], "left_anti").select("a", F.col("child").alias("c"), "b")


def moral(edges: DataFrame) -> DataFrame:
    married = v_structures(edges).select(F.col("a").alias("node1"), F.lit("-").alias("ep1"), F.lit("-").alias("ep2"), F.col("b").alias("node2"))
    return skeleton(edges).union(married).distinct()


def neighbors(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.array_sort(F.collect_set("v")).alias("neighbors"))


def markov_blankets(edges: DataFrame) -> DataFrame:
    """Neighbours and parents of children, of a graph without bidirected edges."""
    into = arrows(edges)
    mates = into.select(F.col("parent").alias("u"), "child").join(into.select(F.col("parent").alias("v"), "child"), "child").where("u <> v").select("u", "v")
    return both_ways(edges).select("u", "v").union(mates).groupBy(F.col("u").alias("node")).agg(F.array_sort(F.collect_set("v")).alias("blanket"))


def ancestors(edges: DataFrame, most: int = 64) -> DataFrame:
    """(ancestor, node) by doubling joins: paths of 1, 2, 4, ... arrows, until nothing is new."""
    reach = arrows(edges).select(F.col("parent").alias("ancestor"), F.col("child").alias("node")).distinct()
    count = reach.count()
    for _ in range(most):
        longer = reach.join(reach.select(F.col("ancestor").alias("node"), F.col("node").alias("to")), "node").select("ancestor", F.col("to").alias("node"))
        reach = reach.union(longer).distinct().checkpoint() if reach.sparkSession.sparkContext.getCheckpointDir() else reach.union(longer).distinct()
        if (now := reach.count()) == count:
            break
        count = now
    return reach


def graph_table(edges: DataFrame, stabilities: DataFrame | None = None) -> DataFrame:
    """source, target, interaction (undir, dir, bidir, ca, cc) and, with stabilities, adjFreq and orientFreq."""
    op = F.concat("ep1", "ep2")
    kind = F.when(op == "--", "undir").when(op == "->", "dir").when(op == ">>", "bidir").when(op == "o>", "ca").when(op == "oo", "cc")
    out = edges.select(F.col("node1").alias("source"), F.col("node2").alias("target"), kind.alias("interaction"))
    if stabilities is None:
        return out
    s = stabilities.select(F.col("var1").alias("source"), F.col("var2").alias("target"), *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in ("undir", "right.dir", "left.dir", "bidir", "right.partdir", "left.partdir", "nondir", "none")])
    m = s.select(F.col("target").alias("source"), F.col("source").alias("target"), "undir", F.col("left_dir").alias("right_dir"), F.col("right_dir").alias("left_dir"), "bidir", F.col("left_partdir").alias("right_partdir"), F.col("right_partdir").alias("left_partdir"), "nondir", "none")
    freq = F.when(F.col("interaction") == "undir", F.col("undir")).when(F.col("interaction") == "dir", F.col("right_dir")).when(F.col("interaction") == "bidir", F.col("bidir")).when(F.col("interaction") == "ca", F.col("right_partdir")).otherwise(F.col("nondir"))
    return out.join(s.union(m), ["source", "target"], "left").select("source", "target", "interaction", (1 - F.col("none")).alias("adjFreq"), freq.alias("orientFreq"))


def compared(est: DataFrame, truth: DataFrame) -> DataFrame:
    one = pairs(est).select("a", "b", F.col("ma").alias("ea"), F.col("mb").alias("eb"))
    return one.join(pairs(truth).select("a", "b", F.col("ma").alias("ta"), F.col("mb").alias("tb")), ["a", "b"], "full_outer")


def shd(est: DataFrame, truth: DataFrame, type: str) -> DataFrame:
    """Structural Hamming distance: 1 for an edge that one graph lacks or a shared one with other marks.

    In a CPDAG an unmatched directed edge, and differing marks that are both directed, count 1 more; a
    PAG the same with o-o in the place of undirected edges.
    """
    plain = {CPDAG: "-", PAG: "o"}.get(type)
    e, t = F.col("ea").isNotNull(), F.col("ta").isNotNull()
    cost = F.when(e & t, F.when((F.col("ea") == F.col("ta")) & (F.col("eb") == F.col("tb")), 0).otherwise(1)).otherwise(1)
    if plain:
        directed = lambda x: ~((F.col(f"{x}a") == plain) & (F.col(f"{x}b") == plain))
        same = (F.col("ea") == F.col("ta")) & (F.col("eb") == F.col("tb"))
        cost = cost + F.when(e & t, F.when(~same & directed("e") & directed("t"), 1).otherwise(0)).when(e, directed("e").cast("int")).otherwise(directed("t").cast("int"))
    return compared(est, truth).agg(F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("SHD"))


def rates(df: DataFrame, prefix: str) -> DataFrame:
    """precision, recall, F1 and MCC of a row of tp, fp, fn, tn; 0 / 0 is NaN."""
    d = lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.when(b == 0, 1.0).otherwise(b))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return df.select(d(tp, tp + fp).alias(f"{prefix}Precision"), d(tp, tp + fn).alias(f"{prefix}Recall"), d(2 * tp, 2 * tp + fp + fn).alias(f"{prefix}F1"), d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias(f"{prefix}MCC"))


def adjacency_metrics(est: DataFrame, truth: DataFrame, nodes: int) -> DataFrame:
    e, t = F.col("ea").isNotNull(), F.col("ta").isNotNull()
    n = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(name)
    got = compared(est, truth).agg(n(e & t, "tp"), n(e & ~t, "fp"), n(~e & t, "fn"))
    return rates(got.withColumn("tn", F.lit(nodes * (nodes - 1) // 2) - F.col("tp") - F.col("fp") - F.col("fn")), "adj")


def orientation_metrics(est: DataFrame, truth: DataFrame, type: str = CPDAG, dag: DataFrame | None = None) -> DataFrame:
    """Over both ends of shared adjacencies, an arrow being positive.

    In PAGs a circle that agrees counts half for either side; where the true mark is a circle, a tail or an
    arrow is judged by whether the node is an ancestor of the other one in the true directed graph, which
    is needed then; an estimated circle at a true tail or arrow is half an error. Undirected graphs have NaN.
    """
    if type == UNDIRECTED:
        return est.sparkSession.createDataFrame([(float("nan"),) * 4], ", ".join(f"orient{m} double" for m in ("Precision", "Recall", "F1", "MCC")))
    if type == PAG and dag is None:
        raise ValueError("the true directed graph is needed for partial ancestral graphs")
    end = lambda at, other, m: F.struct(F.col(at).alias("at"), F.col(other).alias("other"), F.col(f"e{m}").alias("e"), F.col(f"t{m}").alias("t"))
    ends = compared(est, truth).where("ea is not null and ta is not null").select(F.explode(F.array(end("a", "b", "a"), end("b", "a", "b"))).alias("x")).select("x.*")
    ends = ends.withColumn("up", F.lit(False)) if type != PAG else ends.join(ancestors(dag).select(F.col("ancestor").alias("at"), F.col("node").alias("other"), F.lit(True).alias("up")), ["at", "other"], "left").withColumn("up", F.coalesce("up", F.lit(False)))
    e, t, up = F.col("e"), F.col("t"), F.col("up")
    cells = {
        "tp": F.when((e == ">") & ((t == ">") | (t == "o") & ~up), 1.0).when((e == "o") & (t == "o"), 0.5),
        "tn": F.when((e == "-") & ((t == "-") | (t == "o") & up), 1.0).when((e == "o") & (t == "o"), 0.5),
        "fp": F.when((e == ">") & ((t == "-") | (t == "o") & up), 1.0).when((e == "o") & (t == "-"), 0.5),
        "fn": F.when((e == "-") & ((t == ">") | (t == "o") & ~up), 1.0).when((e == "o") & (t == ">"), 0.5),
    }
    return rates(ends.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in cells.items()]), "orient")


def causal_metrics(est: DataFrame, dag: DataFrame) -> DataFrame:
    """Directed edges of a CPDAG that a directed graph has as well."""
    a, b = arrows(est).withColumn("e", F.lit(1)), arrows(dag).withColumn("t", F.lit(1))
    n = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(name)
    e, t = F.col("e").isNotNull(), F.col("t").isNotNull()
    got = a.join(b, ["parent", "child"], "full_outer").agg(n(e & t, "tp"), n(e & ~t, "fp"), n(~e & t, "fn")).withColumn("tn", F.lit(0))
    return rates(got, "causal").drop("causalMCC")


def pr_metrics(est: DataFrame, truth: DataFrame, nodes: int, type: str, dag: DataFrame | None = None) -> DataFrame:
    """One row of adjacency and orientation metrics; each side is one row."""
    return adjacency_metrics(est, truth, nodes).crossJoin(orientation_metrics(est, truth, type, dag))


def all_metrics(est: DataFrame, truth: DataFrame, nodes: int, type: str, dag: DataFrame | None = None) -> DataFrame:
    """One row of SHD, adjacency and orientation metrics; each side is one row."""
    return shd(est, truth, type).crossJoin(pr_metrics(est, truth, nodes, type, dag))


def compare(spark: SparkSession, est: Graph, truth: Graph, dag: Graph | None = None) -> DataFrame:
    """all_metrics of two graphs of one type over the same nodes; anything else is an error."""
    if set(est.nodes) != set(truth.nodes):
        raise ValueError("the graphs have different nodes")
    if est.type != truth.type or est.type not in (UNDIRECTED, CPDAG, PAG):
        raise ValueError(f"a {est.type} cannot be compared with a {truth.type}")
    return all_metrics(est.frame(spark), truth.frame(spark), len(est.nodes), est.type, dag and dag.frame(spark))


def ensemble(samples: DataFrame, boots: int) -> DataFrame:
    """Frequencies of edge kinds over replicate edge frames (with a column `boot`), a row for each pair seen."""
    p = samples.select("boot", F.least("node1", "node2").alias("var1"), F.greatest("node1", "node2").alias("var2"), F.when(F.col("node1") < F.col("node2"), F.concat("ep1", "ep2")).otherwise(F.concat("ep2", "ep1")).alias("k"))
    kinds = {"undir": "--", "right.dir": "->", "left.dir": ">-", "bidir": ">>", "right.partdir": "o>", "left.partdir": ">o", "nondir": "oo"}
    out = p.groupBy("var1", "var2").agg(*[(F.sum((F.col("k") == k).cast("int")) / boots).alias(name) for name, k in kinds.items()], (1 - F.count(F.lit(1)) / boots).alias("none"))
    best = F.greatest(*[F.col(f"`{c}`") for c in (*kinds, "none")])
    ops = {"undir": "---", "right.dir": "-->", "left.dir": "<--", "bidir": "<->", "right.partdir": "o->", "left.partdir": "<-o", "nondir": "o-o", "none": "none"}
    pick = F.lit("none")
    for name, op in reversed(ops.items()):
        pick = F.when(F.col(f"`{name}`") == best, op).otherwise(pick)
    return out.select("var1", pick.alias("interaction"), "var2", *[F.col(f"`{c}`") for c in kinds], "none")
