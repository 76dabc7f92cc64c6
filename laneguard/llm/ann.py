"""Nearest neighbours through low-dimensional stable projections.

A Gaussian (2-stable) projection to ``DIMENSIONS`` coordinates turns a squared distance s into s times a chi-squared
variable. Each part of the rows has a kd-tree over its projections. For a query the tree hands out points in growing
projected distance; they are verified on the original vectors until a chi-squared test says that a nearer vector
would, with the given confidence, have been handed out already.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneguard.llm.near_vectors import usable
from laneguard.session import materialize

DIMENSIONS = 8
CONFIDENCE = 0.98
PART_ROWS = 8_192
QUERY_ROWS = 2_048
LEAF = 64


def chi_squared_quantile(p: float, m: int = DIMENSIONS) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


class Tree:
    """A kd-tree over projected points with the bounding box of every node."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.low, self.high, self.children, self.members = [], [], [], []
        self._build(np.arange(len(points)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray) -> int:
        node, p = len(self.members), self.points[rows]
        self.low.append(p.min(axis=0))
        self.high.append(p.max(axis=0))
        self.children.append(None)
        self.members.append(rows)
        if len(rows) > LEAF:
            axis = int(np.argmax(self.high[node] - self.low[node]))
            order = np.argpartition(p[:, axis], len(rows) // 2)
            halves = rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]
            self.children[node] = (self._build(halves[0]), self._build(halves[1]))
            self.members[node] = None
        return node

    def incremental(self, q: np.ndarray):
        """(squared projected distance that no later point undercuts, next rows), nearest boxes first."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        far = np.einsum("ij,ij->i", gap, gap)
        heap = [(far[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.children[node] is None:
                yield d, self.members[node]
            else:
                for c in self.children[node]:
                    heapq.heappush(heap, (far[c], c))


def search(x: np.ndarray, first_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (rows, distances) of its k nearest rows found; ties go to the smaller first id."""
    project = np.random.default_rng(seed).standard_normal((x.shape[1], DIMENSIONS))
    tree, stop, out = Tree(x @ project), chi_squared_quantile(confidence), []
    for q, pq in zip(queries, queries @ project):
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        worst = math.inf
        for reached, more in tree.incremental(pq):
            if reached > stop * worst * worst:
                break
            d = np.sqrt(((x[more] - q) ** 2).sum(axis=1))
            near = d <= worst
            if near.any():
                rows, dist = np.concatenate([rows, more[near]]), np.concatenate([dist, d[near]])
                if len(rows) > k:
                    best = np.lexsort((first_ids[rows], dist))[:k]
                    rows, dist = rows[best], dist[best]
                if len(rows) == k:
                    worst = dist.max()
        out.append((rows, dist))
    return out


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, confidence: float = CONFIDENCE, seed: int = 11,
                       id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found of each row whose id is divisible by ``every``, by Euclidean
    distance on the original vectors, ties to the smaller id.

    Rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take no part;
    vectors of another length are no candidates. Equal vectors are searched once and stand for their k + 1 smallest
    ids. A repeated row with the same id is one candidate, and a query never finds its own id. With fewer candidates
    all are returned; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda x: x + 0.0))
    rows = rows.withColumn("h", F.md5(F.concat_ws(",", F.col("v").cast("array<string>")).cast("binary"))).dropDuplicates(["vec_id", "h"])
    rows = materialize(rows, "search-rows")
    ranked = rows.select("h", "vec_id", F.row_number().over(Window.partitionBy("h").orderBy("vec_id")).alias("r")).filter(F.col("r") <= k + 1)
    ids = ranked.groupBy("h").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    items = materialize(rows.groupBy("h").agg(F.any_value("v").alias("v")).join(ids, "h"), "search-items")
    queries = materialize(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h", "v"), "search-queries")
    parts = max(1, -(-items.count() // PART_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda col, n: F.pmod(F.xxhash64(col, F.lit(3)), F.lit(n)).cast("int")
    left = items.withColumn("dim", F.size("v")).withColumn("part", deal("h", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("dim", F.size("v")).withColumn("block", deal("query_id", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def find(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(asked):
            ids = some["ids"].tolist()
            first = np.array([i[0] for i in ids])
            found = search(np.stack(some["v"].tolist()), first, np.stack(asked["v"].tolist()), k + 1, confidence, seed)
            for q, h, (at, dist) in zip(asked["query_id"], asked["h"], found):
                out += [(q, h, i, d) for j, d in zip(at, dist) for i in ids[j] if i != q]
        return pd.DataFrame(out, columns=["query_id", "h", "vec_id", "score"])

    keys = ["dim", "part", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, "query_id long, h string, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
