import math

import dagwright.operators.dataset as dataset
from dagwright.operators.dataset import Data
from dagwright.queries import QUERIES


def test_the_model_without_effects_is_fitted_beyond_local_cells(spark, monkeypatch):
    ask = lambda: QUERIES["cox_without_effects"](spark, "/root/testdata/sf0.001").first()[0]
    near = ask()
    monkeypatch.setattr(Data.__init__, "__defaults__", tuple(0 if x == dataset.LOCAL_CELLS else x for x in Data.__init__.__defaults__))
    assert math.isclose(ask(), near, abs_tol=1e-4)
