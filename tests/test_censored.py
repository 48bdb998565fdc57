import numpy as np
import pytest

from dagwright.functions.regression import cox
from dagwright.operators.dataset import Data
from dagwright.operators.independence import DataTest
from dagwright.plans.coxmgm import CoxTerm, coxmgm, coxmgm_path
from dagwright.plans.constraint import pc_stable
from dagwright.plans.simulate import sim_random_dag


@pytest.fixture(scope="module")
def data(spark):
    df, g = sim_random_dag(spark, n=800, p=4, r=1, disc_frac=0.25, degree=2, seed=8)
    return Data(df.cache()), g


def test_gradient_and_unpenalised_fit(data):
    d, _ = data
    term = CoxTerm(d, "Surv1")
    b = np.linspace(-0.3, 0.3, term.x.shape[1])
    f, g = term.smooth(b)
    for i in range(len(b)):
        e = np.zeros_like(b)
        e[i] = 1e-6
        assert abs((term.smooth(b + e)[0] - f) / 1e-6 - g[i]) < 1e-4
    got, _ = term.learn(0.0, 0.0)
    t, e = d.columns["Surv1"]
    cols = [c for v in d.variables if v.kind != "censored" for c in d.columns[v.name]]
    want = cox(d.local[:, t], d.local[:, e], d.local[:, cols]).coef * d.local[:, cols].std(axis=0)
    assert np.allclose(got, want, atol=1e-3)


def test_searches(data):
    d, g = data
    true = g.neighbors("Surv1")
    assert set(true) <= set(coxmgm(d, 0.05).neighbors("Surv1")) and not coxmgm(d, 10.0).marks
    assert len(coxmgm_path(d, [0.3, 0.1])["rows"]) == 2
    p = DataTest(d).p_values([("Surv1", true[0], ())])
    assert p[0] < 0.01
    assert pc_stable(d, alpha=0.01).near["Surv1"]
