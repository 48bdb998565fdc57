from collections import Counter

import pytest
from pyspark.sql import functions as F

from dagwright.operators.dataset import Data, cut_at


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(300).select((F.col("id") % 40).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("b")).cache()


def test_cuts_have_ranks(spark):
    df = spark.createDataFrame([(x,) for x in [-(1 << 62), -5, -5, 0, 7, 7, 7, 1 << 61]], "_h long")
    got = [cut_at(df, r, few=0) for r in range(1, 9)]
    assert got == [cut_at(df, r) for r in range(1, 9)]
    assert got == [(-(1 << 62), 1), (-5, 1), (-5, 2), (0, 1), (7, 1), (7, 2), (7, 3), (1 << 61, 1)]


def test_parts_are_those_of_the_local_rows_and_take_no_window(frame):
    near, far = Data(frame, check=False), Data(frame, check=False, local_cells=0)
    for low, high in ((0, 100), (100, 101), (101, 103), (250, 300), (5, 5)):
        for inside in (True, False):
            part = far.part(low, high, 7, inside=inside)
            rows = near.part(low, high, 7, inside=inside)
            own = part.local if part.local is not None else [r.x for r in part.design.collect()]
            assert Counter(map(tuple, own)) == Counter(map(tuple, rows.local)) and part.n == rows.n
            assert "Window" not in part.df._jdf.queryExecution().toString()
