import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.operators.dataset import Data
from dagwright.operators.independence import DataTest
from dagwright.plans.score import RegressionBic
from dagwright.plans.simulate import sim_random_dag


@pytest.fixture(scope="module")
def frame(spark):
    df, _ = sim_random_dag(spark, n=500, p=3, r=1, disc_frac=0.34, degree=2, seed=8)
    # ties and strata
    t = F.col("Surv1")
    return df.withColumn("Surv1", F.struct(F.round(t["time"], 1).alias("time"), t["event"].alias("event"), F.when(F.col("X1") > 0, "a").otherwise("b").alias("strata")))


def test_cox_fits_by_passes_over_rows(frame):
    here, there = Data(frame), Data(frame.repartition(3), local_cells=0)
    assert there.local is None
    cols = [here.columns["X1"][0], *here.columns["Y1"]]
    a, b = here.cox("Surv1", cols), there.cox("Surv1", cols)
    assert np.allclose(a.coef, b.coef, atol=1e-6) and np.allclose(a.se, b.se, rtol=1e-5) and math.isclose(a.loglik, b.loglik, rel_tol=1e-9)
    assert math.isclose(here.cox("Surv1", []).loglik, there.cox("Surv1", []).loglik, rel_tol=1e-9)


def test_tests_and_scores_do_not_depend_on_size(frame):
    here, there = Data(frame), Data(frame, local_cells=0)
    tests = [("Surv1", "X1", ()), ("Surv1", "Y1", ("X2",))]
    assert np.allclose(DataTest(here).p_values(tests), DataTest(there).p_values(tests), rtol=1e-4, atol=1e-9)
    one, two = (RegressionBic(d).local("Surv1", frozenset({"X2"})) for d in (here, there))
    assert math.isclose(one, two, rel_tol=1e-6)
