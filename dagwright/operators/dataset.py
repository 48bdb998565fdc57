"""A typed data set over any DataFrame: kinds, codes, missing rows, ranks, variance checks, sums over rows.

Continuous columns are numbers, discrete ones strings or booleans coded by sorted level, censored ones
structs of time and event, and of a stratum if they have a field `strata`. All passes over rows go through `Data.sum_rows`, which adds up arrays that
blocks of rows yield; its result is as large as a function of the columns, never of the rows.
"""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagwright.functions.distributions import normal_quantile
from dagwright.functions.regression import Fit, cox, harmonic, null_residuals
from dagwright.operators.survival import cox_of_rows

#: Cells (rows x columns) up to which a data set is held as one local matrix; beyond, every pass is a Spark job.
LOCAL_CELLS = 20_000_000
#: Levels of a discrete column at most; a column with more is no category.
MOST_LEVELS = 1000


@dataclasses.dataclass(frozen=True)
class Variable:
    name: str
    kind: str  # continuous, discrete or censored
    levels: tuple[str, ...] = ()


def finite(df: DataFrame) -> DataFrame:
    """Rows without null, NaN or infinite values in any column."""
    keep = F.lit(True)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        keep &= c.isNotNull()
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                keep &= c[g.name].isNotNull()
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            keep &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(keep)


def kind_of(f: T.StructField) -> str:
    if isinstance(f.dataType, (T.NumericType,)):
        return "continuous"
    if isinstance(f.dataType, (T.StringType, T.BooleanType)):
        return "discrete"
    if isinstance(f.dataType, T.StructType) and {"time", "event"} <= set(f.dataType.names):
        if "strata" in f.dataType.names and not isinstance(f.dataType["strata"].dataType, (T.StringType, T.BooleanType, T.IntegralType)):
            raise TypeError(f"strata of {f.name} are {f.dataType['strata'].dataType.simpleString()}; cast them to a string or an integer")
        return "censored"
    raise TypeError(f"column {f.name} is {f.dataType.simpleString()}; cast it to a number, a string or struct<time, event>")


def npn(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's average rank over n + 1, as the normal quantile scaled to its mean and deviation.

    Columns are ranked one after another: values are counted first, so a task gets distinct values.
    """
    if not columns:
        return df
    given, n = df, df.count()
    for c in columns:
        col = F.col(f"`{c}`").cast("double")
        mean, sd = given.agg(F.avg(col), F.stddev_samp(col)).first()
        scores = rank_scores(given, c, n)
        mapped = scores.select("_v", (quantiles("_p") * F.lit(sd or 0.0) + F.lit(mean)).alias("_q"))
        df = df.withColumn("_v", col).join(mapped, "_v").drop("_v").withColumn(c, F.col("_q")).drop("_q")
    return df


@F.pandas_udf(T.DoubleType())
def quantiles(p: pd.Series) -> pd.Series:
    return p.map(normal_quantile)


def rank_scores(df: DataFrame, c: str, n: int, parts: int = 64) -> DataFrame:
    """Distinct values `_v` of a column and their average rank over n + 1, `_p`.

    Values are dealt into ranges by approximate quantiles, so no task sorts more than a range; ranges
    add up through their totals, a row each.
    """
    counts = df.groupBy(F.col(f"`{c}`").cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    bounds = sorted(set(df.select(F.col(f"`{c}`").cast("double").alias("_v")).approxQuantile("_v", [i / parts for i in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_v"))) if bounds else F.lit(0)
    counts = counts.withColumn("_part", part)
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("_part").agg(F.sum("_n").alias("_t")).select("_part", before.alias("_before"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_below", below).join(F.broadcast(totals), "_part").select("_v", ((F.col("_before") + F.col("_below") + (F.col("_n") + 1) / 2) / (n + 1)).alias("_p"))


def stratum_code(c: Column) -> Column:
    """A stratum as a number: 52 bits of a hash, which a double holds."""
    return F.shiftrightunsigned(F.xxhash64(c["strata"].cast("string")), 12).cast("double")


def warn_of_levels(levels: dict[str, tuple[str, ...]], values: dict[str, int]) -> None:
    """Warns of categories with ten levels or more, and of numbers that have fewer than ten values."""
    for c, x in levels.items():
        if len(x) >= 10:
            warnings.warn(f"{c} has {len(x)} levels; is it a category?", stacklevel=3)
    for c, n in values.items():
        if n < 10:
            warnings.warn(f"{c} has fewer than ten values; is it a number?", stacklevel=3)


def check_strata(df: DataFrame, columns: list[str]) -> None:
    for c in columns:
        col = F.col(f"`{c}`")
        named = df.select(col["strata"].cast("string").alias("s"), stratum_code(col).alias("code")).distinct()
        if not named.groupBy("code").count().where("count > 1").isEmpty():
            raise ValueError(f"two strata of {c} have one hash")


def with_null_residuals(df: DataFrame, c: str, to: str, stratified: bool, parts: int = 64) -> DataFrame:
    """df with `null_residuals` of a censored column, without a task for all rows.

    Rows of a time are counted first; times are dealt into ranges, which add up through their totals.
    """

    @F.pandas_udf(T.DoubleType())  # not of the module: Data is sent by value, with what it refers to
    def hazard_jump(at_risk: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(harmonic(at_risk) - harmonic(at_risk - m))

    col = F.col(f"`{c}`")
    df = df.withColumn("_t", col["time"].cast("double")).withColumn("_s", stratum_code(col) if stratified else F.lit(0.0))
    bounds = sorted(set(df.approxQuantile("_t", [i / parts for i in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_t"))) if bounds else F.lit(0)
    times = df.groupBy("_s", "_t").agg(F.count(F.lit(1)).alias("_n"), F.sum(col["event"].cast("double")).alias("_m")).withColumn("_part", part)

    def summed(t: DataFrame, x: str, to: str, backward: bool) -> DataFrame:
        """Sums of x over the times of a stratum up to each one, or from it on."""
        def along(w, k):
            return w.orderBy(F.desc(k) if backward else F.asc(k))

        totals = t.groupBy("_s", "_part").agg(F.sum(x).alias("_sum"))
        others = F.sum("_sum").over(along(Window.partitionBy("_s"), "_part").rowsBetween(Window.unboundedPreceding, -1))
        totals = totals.select("_s", "_part", F.coalesce(others, F.lit(0)).alias("_others"))
        own = F.sum(x).over(along(Window.partitionBy("_s", "_part"), "_t").rowsBetween(Window.unboundedPreceding, 0))
        return t.withColumn("_own", own).join(totals, ["_s", "_part"]).withColumn(to, F.col("_own") + F.col("_others")).drop("_own", "_others")

    times = summed(times, "_n", "_r", True).withColumn("_jump", hazard_jump(F.col("_r").cast("double"), F.col("_m")))
    times = summed(times, "_jump", "_h", False)
    spared = F.when(F.col("_m") > 0, F.col("_r") * F.col("_jump") / F.col("_m") - 1).otherwise(0.0)
    times = times.select("_s", "_t", "_h", spared.alias("_spared"))
    event = col["event"].cast("double")
    return df.join(times, ["_s", "_t"]).withColumn(to, event - F.col("_h") + event * F.col("_spared")).drop("_s", "_t", "_h", "_spared")


#: Multipliers of the published 64-bit hash behind Spark's xxhash64 (fixed values).
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def mixed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one long, with a seed, over arrays."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in PRIMES)
    turned = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.uint64) + p5 + np.uint64(8)
        h = turned(h ^ (turned(np.asarray(x, np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def draw_keys(keys: np.ndarray, *salt: int) -> np.ndarray:
    """The longs that xxhash64(key, *salt) gives in Spark."""
    h = mixed(keys.view(np.uint64), np.uint64(42))
    for s in salt:
        h = mixed(np.uint64(s % (1 << 64)), h)
    return h.view(np.int64)


def cut_at(hashes: DataFrame, rank: int, few: int = 1 << 16) -> tuple[int, int]:
    """x and t: as many as `rank` of the rows (one, at least) have a hash `_h` under x, but for t that have x itself.

    Rows are counted by the leading bits of the hash, and then within the bits that the cut falls into.
    """
    shift, left = 48, rank
    while True:
        key = F.shiftright("_h", shift)
        for b, c in sorted(map(tuple, hashes.groupBy(key).count().collect())):  # 65,536 at most
            if c >= left:
                break
            left -= c
        if shift == 0:
            return b, left
        hashes, shift = hashes.where(key == b), shift - 16 if c > few else 0


class Data:
    """A data set of p variables, in dummy-expanded design columns."""

    def __init__(self, df: DataFrame, rank: bool = False, check: bool = True, local_cells: int = LOCAL_CELLS, like: Data | None = None):
        names = [c.replace(" ", ".") for c in df.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"column names are not unique: {sorted(names)}")
        df = finite(df.toDF(*names))
        kinds = {f.name: kind_of(f) for f in df.schema.fields}
        if rank:
            df = npn(df, [c for c, k in kinds.items() if k == "continuous"])
        discrete = [c for c, k in kinds.items() if k == "discrete" and like is None]
        numbers = [c for c, k in kinds.items() if k == "continuous" and like is None]
        found = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"`{c}`").alias(f"_{i}") for i, c in enumerate(discrete + numbers)]).first()
        for i, c in enumerate(discrete):
            if found[f"_{i}"] > MOST_LEVELS:
                raise ValueError(f"{c} has about {found[f'_{i}']} levels; it is no category")
        levels = {}
        if discrete:
            sets = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"_{i}") for i, c in enumerate(discrete)]).first()
            levels = {c: tuple(sets[i]) for i, c in enumerate(discrete)}
        if like is not None:  # a part has the levels of the whole
            levels = {v.name: v.levels for v in like.variables}
        else:
            warn_of_levels(levels, {c: found[f"_{i}"] for i, c in enumerate(numbers, len(discrete))})
        strata = [c for c, k in kinds.items() if k == "censored" and "strata" in df.schema[c].dataType.names]
        check_strata(df, strata)
        self.df, self.n, self.spark, self.local_cells, self.strata = df, int(found["n"]), df.sparkSession, local_cells, strata
        self.variables = [Variable(c, kinds[c], levels.get(c, ())) for c in names]
        self.index = {v.name: i for i, v in enumerate(self.variables)}
        #: Design columns of each variable: itself, or a column for each level but the first.
        self.columns, exprs, self.labels = {}, [], []
        for v in self.variables:
            c = F.col(f"`{v.name}`")
            if v.kind == "continuous":
                own = [(c.cast("double"), v.name)]
            elif v.kind == "discrete":
                own = [(F.when(c.cast("string") == x, 1.0).otherwise(0.0), v.name if len(v.levels) == 2 else f"{v.name}MULTINOM.{x}") for x in v.levels[1:]]
            else:
                own = [(c["time"].cast("double"), f"{v.name}.time"), (c["event"].cast("double"), f"{v.name}.event")]
                if v.name in strata:
                    own.append((stratum_code(c), f"{v.name}.strata"))
            self.columns[v.name] = list(range(len(exprs), len(exprs) + len(own)))
            exprs += [e for e, _ in own]
            self.labels += [x for _, x in own]
        #: Design columns that stand for a variable where it is a regressor: its own, or a censored one's working residual.
        self.regressors = dict(self.columns)
        censored = [c for c in names if kinds[c] == "censored"]
        for i, c in enumerate(censored):
            self.regressors[c] = [len(exprs) + i]
            self.labels.append(f"{c}.residual")
        self.width = len(exprs) + len(censored)
        self.local, self.keys, self.cuts = None, None, {}
        if self.n * max(1, self.width) <= local_cells and exprs:
            read = df.select(F.array(*exprs).alias("x"), self.row_key().alias("key")).toArrow()
            self.local = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in read["x"].chunks)]).reshape(-1, len(exprs))
            self.keys = read["key"].to_numpy()
            self.add_residuals()
            self.design = self.plain = None
        else:
            #: The design without working residuals, which take joins.
            self.plain = df.select(F.array(*exprs).alias("x")) if exprs else None
            for i, c in enumerate(censored):
                df = with_null_residuals(df, c, f"_residual{i}", c in strata)
                exprs.append(F.col(f"_residual{i}"))
            self.design = df.select(F.array(*exprs).alias("x")) if exprs else None
        self._gram = None
        if check:
            self.check()

    def __getstate__(self) -> dict:
        """What tasks need of it: names and columns, no rows."""
        return self.__dict__ | {"df": None, "design": None, "plain": None, "local": None, "keys": None, "spark": None}

    def row_key(self) -> Column:
        return F.xxhash64(*[F.col(f"`{v.name}`") for v in self.variables])

    def add_residuals(self) -> None:
        """Appends the working residuals of censored variables to the local matrix."""
        censored = [v.name for v in self.variables if v.kind == "censored"]
        self.local = np.column_stack([self.local, *(null_residuals(*self.survival(c)) for c in censored)]) if self.n else np.zeros((0, self.width))

    def part(self, low: int, high: int, *salt: int, inside: bool = True, least: tuple[float, int, int] | None = None) -> Data:
        """The rows whose rank by the hash of row and salt lies in [low, high), or all others; levels are those of the whole.

        Which rows these are does not depend on partitions, or on whether the rows are held here. With `least`
        a part without enough variation is an error.
        """
        if self.local is not None:
            order = np.argsort(draw_keys(self.keys, *salt), kind="stable")
            rows = np.sort(order[low:high] if inside else np.concatenate([order[:low], order[high:]]))
            return self.of_rows(rows, least)
        df = self.ranked(low, high, salt, inside)
        return Data(df, check=False, local_cells=self.local_cells, like=self).checked(least)

    def ranked(self, low: int, high: int, salt: tuple[int, ...], inside: bool) -> DataFrame:
        """Rows by the ranks of their hashes, by comparisons with the hashes of both ranks.

        Rows that share the hash of a rank are alike, so their number alone tells which belong.
        """
        low, high = max(low, 0), min(high, self.n)
        h = F.xxhash64(self.row_key(), *[F.lit(s).cast("long") for s in salt])
        if low >= high:
            return self.df.where(F.lit(not inside))
        between, shares = F.lit(True), {}  # of rows of a hash: those from one number on and up to another
        for rank, first in ((low, True), (high, False)):
            if 0 < rank < self.n:
                if (salt, rank) not in self.cuts:
                    self.cuts[salt, rank] = cut_at(self.df.select(h.alias("_h")), rank)
                x, t = self.cuts[salt, rank]
                between &= h > x if first else h < x
                a, b = shares.get(x, (0, self.n))
                shares[x] = (t, b) if first else (a, t)
        df = self.df.where(F.when(h.isin(*shares), False).otherwise(between if inside else ~between)) if shares else self.df.where(F.lit(inside))
        for x, (a, b) in shares.items():
            at = 0
            for r in sorted(self.df.where(h == x).groupBy(*[F.col(f"`{c}`") for c in self.df.columns]).count().collect(), key=str):  # one, but where hashes collide
                own = max(0, min(b, at + r["count"]) - max(a, at))
                at, times = at + r["count"], own if inside else r["count"] - own
                if times:
                    one = self.spark.createDataFrame([tuple(r)[:-1]], self.df.schema)
                    df = df.union(self.spark.range(times).crossJoin(F.broadcast(one)).drop("id").select(*[F.col(f"`{c}`") for c in self.df.columns]))
        return df

    def of_rows(self, rows: np.ndarray, least: tuple[float, int, int] | None = None) -> Data:
        """Some of the local rows, as often as they are named."""
        out = object.__new__(Data)
        out.__dict__ = self.__dict__ | {"df": None, "n": len(rows), "keys": self.keys[rows], "_gram": None}
        out.local = self.local[rows][:, : self.width - sum(v.kind == "censored" for v in self.variables)]
        out.add_residuals()
        return out.checked(least)

    def checked(self, least: tuple[float, int, int] | None) -> Data:
        if least is not None:
            self.check(*least)
        return self

    def without(self, names: list[str]) -> Data:
        """The data without some variables."""
        if self.local is None:
            return Data(self.df.drop(*names), check=False, local_cells=self.local_cells, like=self)
        out = object.__new__(Data)
        kept = [v for v in self.variables if v.name not in names]
        old = [c for v in kept for c in self.columns[v.name]]
        residuals = [self.regressors[v.name][0] for v in kept if v.kind == "censored"]
        new = {c: i for i, c in enumerate(old + residuals)}
        out.__dict__ = self.__dict__ | {"df": self.df and self.df.drop(*names), "variables": kept, "index": {v.name: i for i, v in enumerate(kept)}, "columns": {v.name: [new[c] for c in self.columns[v.name]] for v in kept}, "regressors": {v.name: [new[c] for c in self.regressors[v.name]] for v in kept}, "labels": [self.labels[c] for c in old + residuals], "width": len(new), "local": self.local[:, old + residuals], "_gram": None}
        return out

    def survival(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times, events and strata (all 0 if there are none) of a censored variable, from the local matrix."""
        if self.local is None:
            raise ValueError("this needs a data set of at most LOCAL_CELLS cells")
        t, e, *s = self.columns[name]
        return self.local[:, t], self.local[:, e], self.local[:, s[0]] if s else np.zeros(self.n)

    def cox(self, name: str, cols: list[int]) -> Fit:
        """Proportional hazards of a censored variable by design columns, from the local matrix or by passes over the rows."""
        if self.local is not None:
            t, e, s = self.survival(name)
            return cox(t, e, self.local[:, cols], strata=s)
        return cox_of_rows(*self.cox_rows(name, cols))

    def cox_rows(self, name: str, cols: list[int]) -> tuple:
        """What fits of a censored variable by passes over the rows take: rows, columns, means and deviations."""
        t, e, *s = self.columns[name]
        own = len(self.labels) - sum(v.kind == "censored" for v in self.variables)
        if cols:
            g = self.gram()
            mean = g[0, 1:] / self.n
            sd = np.sqrt(np.maximum(np.diag(g)[1:] / self.n - mean**2, 0))
        else:
            mean = sd = np.zeros(self.width)
        return self.plain if max(cols, default=-1) < own else self.design, t, e, s[0] if s else None, list(cols), mean, sd

    def kind(self, name: str) -> str:
        return self.variables[self.index[name]].kind

    def names(self) -> list[str]:
        return [v.name for v in self.variables]

    def sum_rows(self, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of f over blocks of rows; f maps a block of the design to `size` numbers.

        Partial sums of tasks meet in 16 groups before the driver adds those.
        """
        if self.local is not None:
            return np.asarray(f(self.local), float)

        def partial(batches):
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += f(b[0].flatten().to_numpy().reshape(b.num_rows, -1))
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "x"])

        def added(t: pa.Table) -> pa.Table:
            return pa.table({"x": pa.array([sum(np.frombuffer(x) for x in t["x"].to_pylist()).tobytes()], pa.binary())})

        parts = self.design.mapInArrow(partial, "g int, x binary").groupBy("g").applyInArrow(added, "x binary").collect()
        return sum((np.frombuffer(bytes(r.x)) for r in parts), np.zeros(size))

    def gram(self) -> np.ndarray:
        """Moments of [1, design] in one pass: all linear tests and scores follow from them."""
        if self._gram is None:
            w = self.width + 1

            def f(x):
                z = np.hstack([np.ones((len(x), 1)), x])
                return (z.T @ z).ravel()

            self._gram = self.sum_rows(f, w * w).reshape(w, w)
        return self._gram

    def covariance(self) -> np.ndarray:
        g = self.gram()
        mean = g[0, 1:] / self.n
        return (g[1:, 1:] - self.n * np.outer(mean, mean)) / max(1, self.n - 1)

    def check(self, least_var: float = 1e-10, least_rows: int = 5, least_events: int = 10) -> None:
        """Names the first variable without enough variation to be modelled."""
        g = self.gram()
        for v in self.variables:
            cols = self.columns[v.name]
            if v.kind == "continuous":
                mean = g[0, cols[0] + 1] / max(1, self.n)
                var = g[cols[0] + 1, cols[0] + 1] / max(1, self.n) - mean * mean
                if self.n < 2 or var <= least_var * max(1.0, mean * mean):
                    raise ValueError(f"{v.name} has no variance")
            elif v.kind == "discrete":
                counts = [g[0, c + 1] for c in cols]
                counts.insert(0, self.n - sum(counts))
                if len(v.levels) < 2 or min(counts) < least_rows:
                    raise ValueError(f"{v.name} has fewer than two levels, or one with fewer than {least_rows} rows")
            elif g[0, cols[1] + 1] < least_events:
                raise ValueError(f"{v.name} has fewer than {least_events} events")
