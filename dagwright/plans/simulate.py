"""Random directed graphs and mixed data from them, as DataFrame expressions."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagwright.plans.graph import DAG, Graph


def random_dag(names: list[str], degree: float, rng: random.Random) -> Graph:
    """floor(degree * p / 2) edges, drawn without replacement, along a random order."""
    order = list(names)
    rng.shuffle(order)
    pairs = [(a, b) for j, b in enumerate(order) for a in order[:j]]
    g = Graph(list(names), DAG)
    for a, b in rng.sample(pairs, min(len(pairs), int(degree * len(names) / 2))):
        g.orient(a, b)
    return g


def sim_random_dag(spark: SparkSession, n: int = 1000, p: int = 50, r: int = 0, disc_frac: float = 0.5, degree: float = 3, coef_min: float = 0.5, coef_max: float = 1.5, noise_min: float = 1, noise_max: float = 2, censor_rate: float = 0.3, seed: int = 0) -> tuple[DataFrame, Graph]:
    """n rows of p variables, continuous X and three-level Y, and r survival times, with their graph.

    Rows are drawn from hashes of their id, so the data do not depend on partitions. A survival time
    without parents has log hazard 0.
    """
    rng = random.Random(seed)
    k = int(p * disc_frac)
    xs, ys, ts = [f"X{i + 1}" for i in range(p - k)], [f"Y{i + 1}" for i in range(k)], [f"Surv{i + 1}" for i in range(r)]
    g = random_dag([*xs, *ys], degree, rng)
    for t in ts:
        g.near[t] = set()
        g.nodes.append(t)
        for v in rng.sample([*xs, *ys], min(len(xs) + len(ys), max(1, int(degree / 2)))):
            g.orient(v, t)

    def uniform(*salt):
        h = F.xxhash64("id", F.lit(seed), *[F.lit(s) for s in salt])
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)

    def normal(*salt):
        return F.sqrt(-2 * F.log(uniform(*salt, "a"))) * F.cos(2 * 3.141592653589793 * uniform(*salt, "b"))

    coef = lambda: rng.choice((-1, 1)) * rng.uniform(coef_min, coef_max)
    def linear(parents):
        out = F.lit(0.0)
        for w in parents:
            if w in ys:
                a, b = coef(), coef()
                out = out + F.when(F.col(w) == "A", a).when(F.col(w) == "B", b).otherwise(-(a + b))
            else:
                out = out + F.col(w) * coef()
        return out

    made, depth = {}, {}
    for v in g.order():
        parents = g.parents(v)
        depth[v] = 1 + max((depth[w] for w in parents), default=0)
        if v in xs:
            made[v] = linear(parents) + normal(v) * rng.uniform(noise_min, noise_max)
        elif v in ys:
            w = [F.exp(linear(parents)) for _ in range(3)]
            total, u = w[0] + w[1] + w[2], uniform(v)
            made[v] = F.when(u * total < w[0], "A").when(u * total < w[0] + w[1], "B").otherwise("C")
        else:
            time = F.pow(-F.log(uniform(v)) * F.exp(-linear(parents)), 0.5)
            event = (uniform(v, "c") >= censor_rate).cast("int")
            made[v] = F.struct((time * F.when(event == 1, 1.0).otherwise(uniform(v, "t"))).alias("time"), event.alias("event"))
    df, kept = spark.range(n), spark.sparkContext.getCheckpointDir()
    for k in range(1, max(depth.values(), default=0) + 1):
        # variables of one depth at a time: one pass for their means and deviations, and one cut of lineage
        own = [v for v in made if depth[v] == k]
        df = df.select("*", *[made[v].alias(v) for v in own])
        df = df.checkpoint() if kept else df
        scaled = [v for v in own if v in xs]
        if scaled:
            found = df.agg(*[f(v).alias(f"{i}_{v}") for v in scaled for i, f in enumerate((F.avg, F.stddev_samp))]).first()
            df = df.withColumns({v: (F.col(v) - found[f"0_{v}"]) / (found[f"1_{v}"] or 1.0) for v in scaled})
    return df.select(*g.nodes), g
