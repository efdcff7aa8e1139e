"""Exact top-k inner products with a KD-tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

LEAF = 128


class KDTree:
    """Median splits of distinct vectors along the widest axis; every node keeps its tight bounding box.

    Rows of equal vectors are one point; of its ids, sorted, those of the ``k + 1`` smallest are enough
    for any query that leaves out one id, with ``k`` rows each.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leaf: int = LEAF):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)]) if len(ids) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        self.points = vectors[begin]
        self.ids = [self._least(ids[a:b], k) for a, b in zip(begin, [*begin[1:], len(ids)])]
        self.low, self.high, self.kids, self.rows = [], [], [], []
        todo = [(np.arange(len(self.points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            own = self.points[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            n = len(self.low)
            self.low.append(low), self.high.append(high), self.kids.append([]), self.rows.append(None)
            if parent >= 0:
                self.kids[parent].append(n)
            if len(rows) <= leaf:
                self.rows[n] = rows
            else:
                axis, half = int(np.argmax(high - low)), len(rows) // 2
                split = np.argpartition(own[:, axis], half)
                todo += [(rows[split[:half]], n, 0), (rows[split[half:]], n, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.leaves = {n: self.points[r] for n, r in enumerate(self.rows) if r is not None}

    @staticmethod
    def _least(ids: np.ndarray, k: int) -> list[int]:
        out, seen, last, distinct = [], 0, None, 0
        for i in ids.tolist():
            if i != last:
                last, seen, distinct = i, 0, distinct + 1
                if distinct > k + 1:
                    break
            if seen < k:
                out.append(i)
                seen += 1
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that any point of each node's box can have, by query and node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, k: int, kth: float, bounds: np.ndarray) -> list[tuple[int, int]]:
        """The best ``k`` of (-score, id), from nodes whose bound reaches the k-th score known so far."""
        best: list[tuple[int, int]] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < kth:
                break
            if node in self.leaves:
                scores = self.leaves[node] @ query
                near = np.flatnonzero(scores >= kth)
                if len(near) > k:
                    least = np.partition(scores[near], len(near) - k - 1)[len(near) - k - 1]
                    near = near[scores[near] >= least]
                rows = self.rows[node]
                for j in near.tolist():
                    s = -int(scores[j])
                    best += [(s, i) for i in self.ids[rows[j]] if i != own]
                best = sorted(best)[:k]
                if len(best) == k:
                    kth = max(kth, -best[-1][0])
            else:
                for kid in self.kids[node]:
                    if bounds[kid] >= kth:
                        heapq.heappush(queue, (-bounds[kid], kid))
        return best


def quantised(vector: str = "embedding", scale: float = 256.0):
    """floor(scale * x) of each component as doubles; null if the vector, or a component, is null or not finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, block_rows: int = 2048, scale: float = 256.0) -> DataFrame:
    """The ``k`` largest inner products of each query row with every other row, exactly.

    Rows are dealt by hash to shards of about ``shard_rows``, each with a KD-tree. A query is first searched in the shard it lives in;
    its k-th score there goes along to all other shards, where a best-first walk stops at the
    first box that can't reach it. Queries visit shards in blocks, so a task holds one shard and one block; each
    gives at most ``k`` rows a query. The rows of one vector, however many, are one point of a tree.

    Returns query_id, rank, vec_id, score (ties to the smaller id; rows of the query's own id never count). Null ids
    and vectors that are null, or have a null or non-finite component, take no part; vectors of another
    length are never compared; an empty vector scores 0. Repeated candidate rows count each; repeated query rows
    once. Components must stay under 2**21 after scaling (sums are exact in doubles).
    """
    base = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("vec_id"), quantised(vector, scale).alias("v")).where("v is not null")
    base = durable(base.withColumn("dims", F.size("v")))
    shards = max(1, -(-base.count() // shard_rows))
    base = base.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    asked = durable(base.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"]).withColumn("qkey", F.xxhash64("vec_id", "v", F.lit(1))))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod("qkey", F.lit(blocks)).cast("int"))
    found = "qkey long, query_id long, vec_id long, score long"

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            tree = KDTree(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_list()).astype(np.float64).reshape(len(rows), -1), k)
            matrix = np.stack(queries["v"].to_list()).astype(np.float64).reshape(len(queries), -1)
            for at in range(0, len(queries), 256):
                bounds = tree.bounds(matrix[at : at + 256])
                for q, b, key, own, kth in zip(matrix[at : at + 256], bounds, queries["qkey"][at : at + 256], queries["vec_id"][at : at + 256], queries["kth"][at : at + 256]):
                    out += [(key, own, i, -s) for s, i in tree.search(q, own, k, -np.inf if np.isnan(kth) else kth, b)]
        return pd.DataFrame(out, columns=["qkey", "query_id", "vec_id", "score"]).astype("int64")

    def visit(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        keys = ["dims", "shard", "block"]
        return candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, found)

    def spread(df: DataFrame, column: str, n: int) -> DataFrame:
        return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    every = spread(base, "block", blocks)
    home = durable(visit(every, asked.withColumn("kth", F.lit(None).cast("double"))))
    known = home.groupBy("qkey").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("qkey", F.when(F.col("n") >= k, F.col("least")).cast("double").alias("kth"))
    onward = spread(asked.withColumnRenamed("shard", "_home"), "shard", shards).where("shard != _home").drop("_home").join(known, "qkey", "left")
    rank = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))
    best = home.unionByName(visit(every, onward)).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
