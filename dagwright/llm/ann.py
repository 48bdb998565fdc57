"""Approximate nearest neighbours: a forest of random-projection trees for each shard.

A tree splits at the median of the projection on the difference of two of its vectors. A query
walks all trees of a shard through one priority queue, ordered by the margin by which it missed a
branch, until the leaves hold `inspect` of the shard's vectors, or until the least margin left is
wider than the kth distance found, beyond which nothing nearer can lie; those are ranked by exact distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagwright.llm.vectors import dealt, matrix, nothing, ranked, search_shards, usable

TREES, LEAF, SEED = 6, 64, 20260103


class Tree:
    """A random-projection tree: normals and offsets of inner nodes, rows of leaves."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, leaf: int):
        self.normal, self.offset, self.low, self.high, self.rows = [], [], [], [], []
        todo = [(np.arange(len(x)), None, None)]
        while todo:
            rows, side, parent = todo.pop()
            me = len(self.rows)
            if side is not None:
                side[parent] = me
            split = None
            if len(rows) > leaf:
                for _ in range(3):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    w = a - b
                    if (length := math.sqrt(float(w @ w))) > 0 and math.isfinite(length):
                        p = x[rows] @ (w / length)
                        cut = float(np.median(p))
                        if (p <= cut).any() and (p > cut).any():
                            split = w / length, cut, p <= cut
                            break
            self.rows.append(rows if split is None else None)
            self.normal.append(np.zeros(x.shape[1]) if split is None else split[0])
            self.offset.append(0.0 if split is None else split[1])
            self.low.append(-1)
            self.high.append(-1)
            if split is not None:
                todo += [(rows[split[2]], self.low, me), (rows[~split[2]], self.high, me)]
        self.normal, self.offset = np.array(self.normal), np.array(self.offset)


def candidates(trees: list[Tree], margins: list[list[float]], n: int, first: int, most: int, kth: Callable[[np.ndarray], float]) -> np.ndarray:
    """Rows in the leaves that come first in the queue all trees share, until they are `most` or no others can be nearer.

    A row that no leaf has shown yet lies beyond a margin as wide as the queue's least one in every tree.
    kth(rows), the kth distance among them, is asked for when there are `first`, twice as many, and so on.
    """
    seen, count, bound = np.zeros(n, bool), 0, math.inf
    queue = [(0.0, t, 0) for t in range(len(trees))]
    while queue and count < most:
        miss, t, node = heapq.heappop(queue)
        if miss > bound:
            break
        tree, margin = trees[t], margins[t]
        while tree.rows[node] is None:
            m = margin[node]
            near, far = (tree.high[node], tree.low[node]) if m > 0 else (tree.low[node], tree.high[node])
            heapq.heappush(queue, (max(miss, abs(m)), t, far))
            node = near
        seen[tree.rows[node]] = True
        count = int(np.count_nonzero(seen))
        if count >= first:
            bound, first = kth(np.flatnonzero(seen)) * (1 + 1e-9), 2 * first
    return np.flatnonzero(seen)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, inspect: float = 0.8, trees: int = TREES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest found for each query, by Euclidean distance: `query_id, rank, vec_id, score`.

    Queries are rows whose vec_id `every` divides, candidates all rows of another vec_id; ties go to
    the smaller vec_id, fewer than k candidates are all returned. `inspect` is the part of a shard's
    vectors that a query's leaves hold before it stops (at least 16 * k vectors): recall grows with
    it, and on vectors without structure, such as random directions, 0.9 takes more than half. Where
    vectors cluster, margins end the search far earlier.
    Every row is indexed, none sampled. Rows without a vec_id, vectors that are null, empty, zero,
    hold null or non-finite components, or are not of the table's commonest dimension take no part.
    Repeated rows are candidates each; as queries they ask once. Extra columns are not read; an
    empty table gives none.
    """
    got = dealt(usable(vectors, vec_id, embedding, nonzero=True), every)
    if got is None:
        return nothing(vectors, "double")
    points, queries, shards, blocks = got

    def search(shard: int, ids: np.ndarray, v: np.ndarray, asked: pa.Table):
        order = np.lexsort(np.concatenate([v.T, ids[None, :]]))  # the same trees, however rows arrive
        ids, v = ids[order], v[order]
        rng = np.random.default_rng((SEED, shard))
        forest = [Tree(v, rng, LEAF) for _ in range(trees)]
        q = matrix(asked["v"])
        margins = [(q @ t.normal.T - t.offset).tolist() for t in forest]
        most = max(16 * k, math.ceil(inspect * len(v)))
        out = ([], [], [])
        for i, own in enumerate(asked["query_id"].to_pylist()):

            def kth(rows: np.ndarray, i: int = i, own: int = own) -> float:
                d = ((v[rows[ids[rows] != own]] - q[i]) ** 2).sum(axis=1)
                return math.sqrt(np.partition(d, k - 1)[k - 1]) if len(d) >= k else math.inf

            rows = candidates(forest, [m[i] for m in margins], len(v), 8 * k, most, kth)
            rows = rows[ids[rows] != own]
            score = np.sqrt(((v[rows] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[rows], score))[:k]
            out[0].extend([own] * len(best))
            out[1].extend(ids[rows[best]].tolist())
            out[2].extend(score[best].tolist())
        return out

    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    return ranked(search_shards(points, queries.select("query_id", "v", all_shards, "block"), blocks, search, "double"), k, ascending=True)
