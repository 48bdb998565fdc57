"""Cox regressions over rows that are not held locally: sums by time, added up from the last time to the first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagwright.functions.distributions import normal_two_sided
from dagwright.functions.regression import Fit


def summed_from_the_end(times: DataFrame, columns: list[str]) -> DataFrame:
    """times (a row for each stratum and time, with a range `_part` of times) with each column summed over the times of the stratum from its own on."""
    w = Window.partitionBy("_s", "_part").orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_s").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = times.groupBy("_s", "_part").agg(*[F.sum(c).alias(c) for c in columns])
    totals = totals.select("_s", "_part", *[F.coalesce(F.sum(c).over(after), F.lit(0.0)).alias(f"after_{c}") for c in columns])
    own = times.select("*", *[F.sum(c).over(w).alias(f"own_{c}") for c in columns]).join(totals, ["_s", "_part"])
    return own.select(*[c for c in times.columns if c not in columns], *[(F.col(f"own_{c}") + F.col(f"after_{c}")).alias(c) for c in columns])


def added(df: DataFrame, f: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum of f over blocks of rows; partial sums meet in 16 groups before the driver adds them."""

    def partial(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f({n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "x"])

    def together(t: pa.Table) -> pa.Table:
        return pa.table({"x": pa.array([sum(np.frombuffer(x) for x in t["x"].to_pylist()).tobytes()], pa.binary())})

    parts = df.mapInArrow(partial, "g int, x binary").groupBy("g").applyInArrow(together, "x binary").collect()
    return sum((np.frombuffer(bytes(r.x)) for r in parts), np.zeros(size))


def likelihood_of_rows(design: DataFrame, time: int, event: int, strata: int | None, cols: list[int], mean: np.ndarray, sd: np.ndarray, efron: bool = True, parts: int = 64) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """The partial log-likelihood of scaled columns of arrays `x`, by effects: itself, its gradient and its information, by a pass over the rows.

    With Efron's form of ties or Breslow's. Each pass groups rows by stratum and time before anything is
    ordered, so that no task gets more than the distinct times of a range.
    """
    x, k = F.col("x"), len(cols)
    rows = design.select((x[strata] if strata is not None else F.lit(0.0)).alias("_s"), x[time].alias("_t"), x[event].alias("_e"), *[((x[c] - float(mean[c])) / float(sd[c] or 1.0)).alias(f"z{i}") for i, c in enumerate(cols)])
    bounds = sorted(set(rows.approxQuantile("_t", [i / parts for i in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_t"))) if bounds else F.lit(0)
    two = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["0", *(f"1_{i}" for i in range(k)), *(f"2_{i}_{j}" for i, j in two)]

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.col(f"z{i}") * float(v) for i, v in enumerate(b)), F.lit(0.0))
        w = F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), eta)))
        each = {"0": w} | {f"1_{i}": w * F.col(f"z{i}") for i in range(k)} | {f"2_{i}_{j}": w * F.col(f"z{i}") * F.col(f"z{j}") for i, j in two}
        e = F.col("_e")
        died = each if efron else {}
        sums = [*[F.sum(v).alias(f"r{n}") for n, v in each.items()], *[F.sum(v * e).alias(f"d{n}") for n, v in died.items()], F.sum(e).alias("_m"), F.sum(e * eta).alias("_eta"), *[F.sum(e * F.col(f"z{i}")).alias(f"e{i}") for i in range(k)]]
        times = rows.groupBy("_s", "_t").agg(*sums).withColumn("_part", part)
        times = summed_from_the_end(times, [f"r{n}" for n in names]).where("_m > 0").drop("_s", "_t", "_part")

        def passed(c: dict[str, np.ndarray]) -> np.ndarray:
            m = c["_m"].astype(int)
            if efron:  # each event has a risk set of its own
                which = np.repeat(np.arange(len(m)), m)
                share = (np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)) / m[which]
                sums, m = {n: c[f"r{n}"][which] - share * c[f"d{n}"][which] for n in names}, np.ones(len(which))
            else:
                sums = {n: c[f"r{n}"] for n in names}
            r1 = [sums[f"1_{i}"] / sums["0"] for i in range(k)]
            hess = [m @ (sums[f"2_{i}_{j}"] / sums["0"] - r1[i] * r1[j]) for i, j in two]
            return np.array([c["_eta"].sum() - m @ np.log(sums["0"]), *(c[f"e{i}"].sum() - m @ r1[i] for i in range(k)), *hess])

        got = added(times, passed, 1 + k + len(two))
        h = np.zeros((k, k))
        for v, (i, j) in zip(got[1 + k :], two, strict=True):
            h[i, j] = h[j, i] = v
        return float(got[0]), got[1 : 1 + k], h

    return at


def cox_of_rows(design: DataFrame, time: int, event: int, strata: int | None, cols: list[int], mean: np.ndarray, sd: np.ndarray, most: int = 30) -> Fit:
    """Proportional hazards by Newton steps, with Efron's ties, of columns of arrays `x`; the same fit as over a local matrix."""
    k, at = len(cols), likelihood_of_rows(design, time, event, strata, cols, mean, sd)
    b, last, hess = np.zeros(k), None, np.zeros((k, k))
    for _ in range(most):
        ll, grad, hess = at(b)
        if k == 0 or last is not None and abs(ll - last) <= 1e-9 * max(1.0, abs(ll)):
            break
        last = ll
        step = np.linalg.solve(hess, grad)
        b = b + step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-12))
    else:
        raise ValueError("no convergence")
    se = np.sqrt(np.diag(np.linalg.inv(hess))) if k else np.zeros(0)
    if not np.isfinite(se).all():
        raise ValueError("no finite fit")
    scale = np.array([float(sd[c] or 1.0) for c in cols])
    return Fit(b / scale, se / scale, np.array([normal_two_sided(v) for v in b / se]), loglik=ll)
