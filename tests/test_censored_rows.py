import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.operators.dataset import Data
from dagwright.plans.coxmgm import CoxRows, CoxTerm, coxmgm_path
from dagwright.plans.simulate import sim_random_dag


@pytest.fixture(scope="module")
def frame(spark):
    df, _ = sim_random_dag(spark, n=500, p=3, r=1, disc_frac=0.34, degree=2, seed=8)
    t = F.col("Surv1")  # ties and strata
    return df.withColumn("Surv1", F.struct(F.round(t["time"], 1).alias("time"), t["event"].alias("event"), F.when(F.col("X1") > 0, "a").otherwise("b").alias("strata"))).cache()


def test_the_censored_term_by_passes_over_rows(frame):
    near, far = CoxTerm(Data(frame), "Surv1"), CoxRows(Data(frame.repartition(3), local_cells=0), "Surv1")
    b = np.linspace(-0.3, 0.3, near.x.shape[1])
    (f, g), (f2, g2) = near.smooth(b), far.smooth(b)
    assert math.isclose(f, f2, rel_tol=1e-9) and np.allclose(g, g2, atol=1e-9)
    for lam in (0.0, 0.03):
        (one, loss), (two, loss2) = near.learn(lam, lam), far.learn(lam, lam)
        assert np.allclose(one, two, atol=1e-4) and math.isclose(loss, loss2, abs_tol=1e-5) and np.array_equal(one == 0, two == 0)


def test_coxmgm_beyond_local_cells(frame):
    near, far = Data(frame), Data(frame, local_cells=0)
    a, b = coxmgm_path(near, [0.05]), coxmgm_path(far, [0.05])
    assert sorted(a["bic"].edges()) == sorted(b["bic"].edges())
    a, b = a["rows"][0], b["rows"][0]
    assert a["nParams"] == b["nParams"] and math.isclose(a["loglik"], b["loglik"], rel_tol=1e-4)
