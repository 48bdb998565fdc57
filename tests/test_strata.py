import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.functions.regression import cox
from dagwright.operators.dataset import Data
from dagwright.operators.independence import DataTest
from dagwright.plans.coxmgm import CoxTerm
from dagwright.plans.score import RegressionBic


@pytest.fixture(scope="module")
def rows():
    """Times of a stratum are on a scale of its own, and x is higher in the slower one."""
    rng = np.random.default_rng(3)
    s = rng.integers(0, 3, 600)
    x = rng.normal(size=600) + s
    t = np.ceil(rng.exponential(1, 600) * 10.0**s * np.exp(-0.4 * x) * 20)
    return t, (rng.random(600) < 0.7).astype(int), s, x


def frame(spark, rows, strata):
    t, e, s, x = rows
    df = spark.createDataFrame([(float(a), int(b), int(c), float(d)) for a, b, c, d in zip(t, e, s, x, strict=True)], "t double, e int, s int, x double")
    return df.select(F.struct(F.col("t").alias("time"), F.col("e").alias("event"), *([F.col("s").cast(strata).alias("strata")] if strata else [])).alias("T"), "x")


def partial_loglik(rows, b, breslow=False):
    t, e, s, x = rows
    out = 0.0
    for k in set(s):
        for at in set(t[(s == k) & (e == 1)]):
            risk, died = (s == k) & (t >= at), (s == k) & (t == at) & (e == 1)
            m = died.sum()
            out += b * x[died].sum()
            for i in range(m):
                out -= np.log(np.exp(b * x[risk]).sum() - (0 if breslow else i / m) * np.exp(b * x[died]).sum())
    return out


@pytest.mark.parametrize("strata", ["string", "int"])
def test_risk_sets_are_those_of_a_stratum(spark, rows, strata):
    d, pooled = Data(frame(spark, rows, strata)), Data(frame(spark, rows, None))
    t, e, s, x = rows
    fit = cox(t, e.astype(float), x[:, None], strata=s.astype(float))
    b = fit.coef[0]
    assert partial_loglik(rows, b) > max(partial_loglik(rows, b + h) for h in (-1e-3, 1e-3))
    p, q = (DataTest(v).p_values([("T", "x", ())])[0] for v in (d, pooled))
    assert np.isclose(p, fit.p[0]) and not np.isclose(p, q)
    want = -2 * (partial_loglik(rows, b) - partial_loglik(rows, 0.0)) + np.log(e.sum())
    assert np.isclose(RegressionBic(d).local("T", frozenset({"x"})), want)
    term = CoxTerm(d, "T")
    f, g = term.smooth(np.array([0.3]))
    assert np.isclose(f, -partial_loglik(rows, 0.3 / x.std(), True) / 600)
    assert abs((term.smooth(np.array([0.3 + 1e-6]))[0] - f) / 1e-6 - g[0]) < 1e-4


def test_numeric_strata_are_rejected(spark, rows):
    with pytest.raises(TypeError, match="strata of T"):
        Data(frame(spark, rows, "double"))
