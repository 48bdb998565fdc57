import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.functions.regression import harmonic, null_residuals
from dagwright.operators.dataset import Data
from dagwright.operators.independence import DataTest
from dagwright.plans.constraint import pc_stable
from dagwright.plans.score import RegressionBic


@pytest.fixture(scope="module")
def df(spark):
    """a and b, and the categories u and v, depend on each other by the frailty that the time shows."""
    rng = np.random.default_rng(5)
    n = 1500
    t = np.ceil(rng.exponential(20, n))
    e, s = (rng.random(n) < 0.8).astype(int), rng.integers(0, 2, n)
    z = null_residuals(t, e.astype(float), s.astype(float))
    a, b = z + rng.normal(size=n), z + rng.normal(size=n)
    u, v = (z + 0.5 * rng.normal(size=n) > 0), (z + 0.5 * rng.normal(size=n) > 0)
    rows = [(float(i), int(j), int(k), float(x), float(y), bool(p), bool(q)) for i, j, k, x, y, p, q in zip(t, e, s, a, b, u, v, strict=True)]
    out = spark.createDataFrame(rows, "t double, e int, s int, a double, b double, u boolean, v boolean")
    return out.select(F.struct(F.col("t").alias("time"), F.col("e").alias("event"), F.col("s").alias("strata")).alias("T"), "a", "b", "u", "v").cache()


def test_residuals_by_hand():
    assert np.allclose(harmonic([0, 1, 64, 65, 5000]), [0, 1, *(sum(1 / i for i in range(1, k + 1)) for k in (64, 65, 5000))], atol=1e-12)
    t, e, s = np.array([3.0, 1, 1, 2, 5, 4]), np.array([0.0, 1, 1, 1, 1, 0]), np.array([0, 0, 0, 0, 1, 1.0])
    want = []
    for i in range(len(t)):
        h = 0.0
        for k in {x for x in t[(s == s[i]) & (e == 1)] if x <= t[i]}:
            risk, m = ((s == s[i]) & (t >= k)).sum(), int(((s == s[i]) & (t == k) & (e == 1)).sum())
            h += sum((1 - (j / m if t[i] == k and e[i] else 0)) / (risk - j) for j in range(m))
        want.append(e[i] - h)
    assert np.allclose(null_residuals(t, e, s), want)


def test_a_censored_variable_separates_others(df):
    d = Data(df)
    test = DataTest(d)
    for x, y in (("a", "b"), ("a", "u"), ("u", "v")):
        apart, given = test.p_values([(x, y, ()), (x, y, ("T",))])
        assert apart < 1e-6 and given > 1e-3
    assert not pc_stable(Data(df.select("T", "a", "b")), alpha=0.001).adjacent("a", "b")
    r = d.local[:, d.regressors["T"][0]]
    a = d.local[:, d.columns["a"][0]]
    want = d.n * np.log(1 - np.corrcoef(r, a)[0, 1] ** 2) + np.log(d.n)
    assert np.isclose(RegressionBic(d).local("a", frozenset({"T"})), want)


def test_tests_given_a_censored_variable_do_not_need_a_local_matrix(df):
    near, far = Data(df), Data(df, local_cells=0)
    assert far.local is None and np.allclose(near.gram()[-1, [0, 1, 2, 4, 5, 6, 7, 8]], far.gram()[-1, [0, 1, 2, 4, 5, 6, 7, 8]], atol=1e-6)
    asked = [("a", "b", ("T",)), ("u", "v", ("T",))]
    assert np.allclose(DataTest(near).p_values(asked), DataTest(far).p_values(asked), rtol=1e-5)
