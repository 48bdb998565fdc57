"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagwright.llm.common import FILE_ROWS, drop, pieces, written


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges (a, b) of longs, `rows` of them at most if given, to (node, comp), comp the least node of its component.

    Each star operation sends every node one minimum and keeps one edge for each edge it had; no
    group is gathered anywhere. The edge set ends as one star for each component.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows if rows is None else pieces(rows, FILE_ROWS))
    before, old = None, None
    while True:
        if old is not None:
            drop(old)
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct()).groupBy("node").agg(F.min("comp").alias("comp"))
        before = (n, total)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        e, old = written(small, "edges", pieces(n, FILE_ROWS)), e
