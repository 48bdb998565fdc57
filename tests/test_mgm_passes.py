import numpy as np
import pytest

import dagwright.plans.mgm as of_mgm
from dagwright.operators.dataset import Data
from dagwright.plans.mgm import Mgm, mgm_path, triple
from dagwright.plans.simulate import sim_random_dag


@pytest.fixture(scope="module")
def data(spark):
    df, _ = sim_random_dag(spark, n=2000, p=6, disc_frac=0.5, degree=2, seed=4)
    return Data(df.cache())


def test_moments_and_information_give_loss_and_gradient(data):
    m = Mgm(data)
    v = m.learn(triple(0.05)).params
    at = m.softmax(v)
    (f1, g1), (f2, g2), (f, g) = m.gaussian(v), m.near(at, v), m.smooth(v)
    assert np.isclose(f1 + f2, f) and np.allclose(g1 + g2, g, atol=1e-9)
    e = 1e-4 * (m.learn(triple(0.02)).params - v)
    want = m.smooth(v + e)[1]
    assert np.allclose(m.gaussian(v + e)[1] + m.near(at, v + e)[1], want, atol=1e-7)


def test_both_ways_to_learn_reach_one_optimum(data, monkeypatch):
    m = Mgm(data)
    cost = lambda fit, lam: fit.loss + m.prox(fit.params, 0.0, triple(lam))[1]
    for lam in (0.3, 0.1, 0.03):
        newton = m.learn(triple(lam))
        monkeypatch.setattr(of_mgm, "INFORMATION", 0)
        first = m.learn(triple(lam), eps=1e-8, most=5000)
        monkeypatch.undo()
        assert np.isclose(newton.loss, m.smooth(newton.params)[0], atol=1e-9)
        assert cost(newton, lam) <= cost(first, lam) + 1e-7 and np.allclose(newton.params, first.params, atol=1e-3) and newton.count == first.count


def test_a_path_takes_few_passes(data, monkeypatch):
    passes = []
    given = Data.sum_rows
    monkeypatch.setattr(Data, "sum_rows", lambda self, f, size: passes.append(size) or given(self, f, size))
    mgm_path(data, n_lambda=8)
    assert len(passes) < 80
