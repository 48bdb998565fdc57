"""Exact top-k by inner product: KD-trees per shard, searched best first.

Each shard of at most SHARD_ROWS vectors builds a KD-tree by median splits of its widest
dimension, with a tight bounding box for each node. A query visits nodes by the greatest inner
product that their boxes allow, and stops at the first that cannot reach its kth score. A query's
kth score in one shard, its home, is propagated to all others, so most of their boxes are skipped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagwright.llm.common import written
from dagwright.llm.vectors import dealt, matrix, nothing, ranked, search_shards, usable

LEAF = 128


class KdTree:
    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.lo, self.hi, self.children, self.rows = x, [], [], [], []
        todo = [(np.arange(len(x)), None)]
        while todo:
            rows, parent = todo.pop()
            me = len(self.lo)
            if parent is not None:
                self.children[parent].append(me)
            own = x[rows]
            lo, hi = own.min(axis=0), own.max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.children.append([])
            self.rows.append(rows)
            if len(rows) > leaf and (hi > lo).any():
                order = np.argsort(own[:, int((hi - lo).argmax())], kind="stable")
                half = len(rows) // 2
                todo += [(rows[order[:half]], me), (rows[order[half:]], me)]
                self.rows[me] = None
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Per query and node the greatest inner product with a point of the node's box."""
        return np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T

    def best(self, q: np.ndarray, bounds: list, ids: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best but `own`, of those that reach floor."""
        found, scores, kth = np.zeros(0, np.int64), np.zeros(0, self.x.dtype), floor
        queue = [(-bounds[0], 0)]
        while queue:
            most, node = heapq.heappop(queue)
            if -most < kth:  # none of the others is better; one as good may have a smaller id
                break
            if self.rows[node] is None:
                for c in self.children[node]:
                    if bounds[c] >= kth:
                        heapq.heappush(queue, (-bounds[c], c))
                continue
            rows = self.rows[node]
            s = self.x[rows] @ q
            good = (s >= kth) & (ids[rows] != own)
            if good.any():
                found, scores = np.concatenate([found, ids[rows[good]]]), np.concatenate([scores, s[good]])
                order = np.lexsort((found, -scores))[:k]
                found, scores = found[order], scores[order]
                if len(scores) == k:
                    kth = max(kth, scores[-1])
        return found, scores


def quantised(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v), in a type in which inner products of such vectors are exact."""
    x = np.floor(v * float(scale))
    return x if v.shape[1] * float(np.abs(x).max(initial=0)) ** 2 < 2**52 else np.array([[int(c) for c in r] for r in x], dtype=object)


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k greatest integer inner products of floor(scale * x) for each query: `query_id, rank, vec_id, score`.

    Queries are rows whose vec_id `every` divides, candidates all rows of another vec_id (fewer than
    k are all returned); ties go to the smaller vec_id. Rows without a vec_id, vectors that are null,
    empty, hold null or non-finite components, or are not of the table's commonest dimension take no
    part. Repeated rows are candidates each; as queries they ask once. Zero vectors score 0. Extra
    columns are not read; an empty table gives none. Scores beyond a long saturate.
    """
    got = dealt(usable(vectors, vec_id, embedding, nonzero=False), every)
    if got is None:
        return nothing(vectors, "long")
    points, queries, shards, blocks = got
    home = F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")

    def search(shard: int, ids: np.ndarray, v: np.ndarray, asked: pa.Table):
        both = quantised(np.concatenate([v, matrix(asked["v"])]), scale)
        tree, q = KdTree(both[: len(v)]), both[len(v) :]
        floors = asked["floor"].to_pylist()
        out = ([], [], [])
        for i, (own, bounds) in enumerate(zip(asked["query_id"].to_pylist(), tree.bounds(q).tolist(), strict=True)):
            floor = float("-inf") if floors[i] is None else floors[i]
            found, scores = tree.best(q[i], bounds, ids, own, k, floor)
            out[0].extend([own] * len(found))
            out[1].extend(found.tolist())
            out[2].extend(max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores)
        return out

    first = queries.select("query_id", "v", home.alias("shard"), "block", F.lit(None).cast("long").alias("floor"))
    near = written(search_shards(points, first, blocks, search, "long"), "home")
    floors = near.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    others = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    rest = queries.join(floors, "query_id", "left").select("query_id", "v", others, "block", "floor").where(F.col("shard") != home)
    return ranked(near.union(search_shards(points, rest, blocks, search, "long")), k, ascending=False)
