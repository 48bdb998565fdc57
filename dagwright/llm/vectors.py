"""Vectors dealt into shards, and queries against every shard in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagwright.llm.common import pieces

#: Most vectors of a shard and queries of a block; a small table still has up to MOST_SMALL shards, to keep all cores busy.
SHARD_ROWS, LEAST_ROWS, MOST_SMALL, QUERY_BLOCK = 1 << 16, 512, 64, 4096


def usable(vectors: DataFrame, vec_id: str, embedding: str, nonzero: bool) -> DataFrame:
    """vec_id and v, without rows that have no vec_id and vectors that are null, empty, hold null or non-finite components or, with nonzero, are zero."""
    v = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    out = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(fine & F.exists("v", lambda x: x != 0) if nonzero else fine)


def dealt(points: DataFrame, every: int) -> tuple[DataFrame, DataFrame, int, int] | None:
    """Points of the table's commonest dimension with their shard, queries with their block, and the numbers of both.

    Queries are the rows whose vec_id `every` divides; of rows that share a vec_id the least vector asks.
    """
    kinds = points.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if kinds is None:
        return None
    points = points.where(F.size("v") == kinds.d)
    shards = max(pieces(kinds["count"], SHARD_ROWS), min(pieces(kinds["count"], LEAST_ROWS), MOST_SMALL))
    blocks = pieces(kinds["count"], every * QUERY_BLOCK)
    queries = points.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    return points.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v"), queries.select(F.col("vec_id").alias("query_id"), "v", block.alias("block")), shards, blocks


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def search_shards(points: DataFrame, queries: DataFrame, blocks: int, search: Callable, score: str) -> DataFrame:
    """search(shard, ids, vectors, query table) for every (shard, block) that queries, which have both columns, name."""
    kind = pa.float64() if score == "double" else pa.int64()

    def found(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        q = v = s = ()
        if len(left) and len(right):
            q, v, s = search(key[0].as_py(), left["vec_id"].to_numpy(), matrix(left["v"]), right)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, kind)})

    grid = points.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    return grid.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(found, f"query_id long, vec_id long, score {score}")


def ranked(near: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The k best rows of each query, ties to the smaller vec_id; near has k rows of each query and shard at most."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nothing(df: DataFrame, score: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
