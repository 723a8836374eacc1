"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt into shards of bounded size by a hash. A shard's tree
splits at medians along the widest side, by rows and not by values, so that
equal vectors do no harm; every node keeps a tight box and its smallest id.
A query walks a tree best first: by the largest inner product that the box
allows. It stops at a node that can't beat the k-th best so far, ties going to
smaller ids.

First every query searches the shard that it would itself fall into. Its k-th
best then goes along to all other shards, where it prunes from the start; a
shard returns only what is better. Queries travel in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heappushpop

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors of a shard on average, vectors of a leaf, queries of a block.
SHARD_ROWS = 4096
LEAF_ROWS = 64
QUERY_BLOCK = 1024
SCALE = 256
K = 5

#: Least and greatest score; others count as the nearest of these.
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
#: What everything is better than.
_NOTHING = (LEAST - 1, 0)


def saturated(scores: np.ndarray) -> np.ndarray:
    """Scores that fit 64 bits; exact floats always do."""
    return scores if scores.dtype != object else np.maximum(np.minimum(scores, GREATEST), LEAST)


class Tree:
    """A KD-tree over whole-number vectors (rows of ``points``) with their ids.

    ``names`` tell rows of one id apart.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, names: np.ndarray | None = None) -> None:
        self.ids, self.points, self.names = ids, points, ids if names is None else names
        self.low, self.high, self.first, self.kids, self.rows = [], [], [], [], []
        self._add(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _add(self, rows: np.ndarray) -> int:
        node, part = len(self.first), self.points[rows]
        low, high = part.min(0), part.max(0)
        self.low.append(low)
        self.high.append(high)
        self.first.append(int(self.ids[rows].min()))
        self.kids.append(None)
        self.rows.append(None)
        if len(rows) <= LEAF_ROWS or not part.shape[1] or (high == low).all():
            self.rows[node] = rows[np.argsort(self.ids[rows], kind="stable")]
            return node
        side = int(np.argmax(high - low))
        order = np.argpartition(part[:, side], len(rows) // 2)
        half = len(rows) // 2
        self.kids[node] = (self._add(rows[order[:half]]), self._add(rows[order[half:]]))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product with any point of each box, queries by nodes."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return saturated(up @ self.high.T + down @ self.low.T)

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: tuple[int, int]) -> list[tuple[int, int]]:
        """The k best (score, -id) apart from the row ``own`` that are better than ``floor``."""
        best: list[tuple[int, int]] = []
        waiting = [(-bounds[0], self.first[0], 0)]
        while waiting:
            bound, first, node = heappop(waiting)
            if (-bound, -first) <= (best[0] if len(best) == k else floor):
                if -bound < (best[0] if len(best) == k else floor)[0]:
                    break  # no later node allows more
                continue
            if self.kids[node] is not None:
                for kid in self.kids[node]:
                    heappush(waiting, (-bounds[kid], self.first[kid], kid))
                continue
            rows = self.rows[node]
            scores = saturated(self.points[rows] @ query)
            least = (best[0] if len(best) == k else floor)[0]
            for i in np.flatnonzero(scores >= least):
                found = (int(scores[i]), -int(self.ids[rows[i]]))
                if self.names[rows[i]] == own or found <= floor:
                    continue
                if len(best) < k:
                    best.append(found)
                    if len(best) == k:
                        heapify(best)
                elif found > best[0]:
                    heappushpop(best, found)
        return best


def whole_numbers(vectors: list, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers: exact floats while sums stay below 2^53, else Python integers."""
    rows = np.array(vectors, dtype=np.float64).reshape(len(vectors), dims)
    scaled = np.floor(rows * SCALE)
    if scaled.size and np.abs(scaled).max() ** 2 * dims >= 2.0**53:
        return np.vectorize(int, otypes=[object])(scaled)
    return scaled


def _search(k: int):
    """Searches a shard (left, the vectors) for a block of queries (right)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            dims = int(left["dims"].iloc[0])
            both = whole_numbers([*left["v"], *right["v"]], dims)
            points, queries = both[: len(left)], both[len(left) :]
            tree = Tree(left["vec_id"].to_numpy(np.int64), points, left["row"].to_numpy(np.int64))
            for lo in range(0, len(queries), 128):
                bounds = tree.bounds(queries[lo : lo + 128])
                for i, row in enumerate(right.iloc[lo : lo + 128].itertuples()):
                    floor = (int(row.floor_score), -int(row.floor_id)) if row.floored else _NOTHING
                    for score, neg in tree.search(queries[lo + i], bounds[i], int(row.query_row), k, floor):
                        out["query_row"].append(row.query_row)
                        out["query_id"].append(row.query_id)
                        out["vec_id"].append(-neg)
                        out["score"].append(score)
        return pd.DataFrame(out).astype("int64")

    return run


_FOUND = "query_row long, query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The k best other vectors of each query by the inner product of floor(256 * x).

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on them.
    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where
    there are fewer vectors. Ties go to the smaller vec_id. Vectors without
    id, null ones and those with a null or non-finite component take no part;
    only vectors of equal length are compared. Rows that repeat a vec_id are
    rows of their own: each is a candidate for all others, and each query row
    has its own ranks. Scores beyond 64 bits count as the nearest 64-bit value.
    """
    spark = vectors.sparkSession
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    real = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    one = real.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        values.alias("v"),
        is_query.alias("asked"),
        F.size(values).alias("dims"),
    )
    one = written(one, "vectors")
    total = one.count()
    shards = max(1, -(-total // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    asked = one.filter("asked").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v", "dims", shard.alias("home"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "query_row"), F.lit(blocks))), "queries")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    rows = one.select("row", "vec_id", "v", "dims", shard.alias("shard")).withColumn("block", every_block)
    by = ["shard", "block", "dims"]

    def searched(queries: DataFrame) -> DataFrame:
        return written(rows.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(_search(k), _FOUND), "found")

    none = queries_floor(asked.withColumn("shard", F.col("home")))
    home = searched(none)
    kth = _best(home, k).filter(F.col("rank") == k).select("query_row", F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
    known = asked.join(kth, "query_row", "left")
    away = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).filter("shard <> home")
    far = searched(queries_floor(away))
    best = _best(home.union(far), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def queries_floor(queries: DataFrame) -> DataFrame:
    """Queries with what they must beat, as far as that is known."""
    floored = F.col("floor_id").isNotNull() if "floor_id" in queries.columns else F.lit(False)
    queries = queries.withColumn("floored", floored)
    for name in ("floor_score", "floor_id"):
        value = F.coalesce(F.col(name), F.lit(0)) if name in queries.columns else F.lit(0)
        queries = queries.withColumn(name, value.cast("long"))
    return queries.select("query_row", "query_id", "v", "dims", "shard", "block", "floored", "floor_score", "floor_id")


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH whole AS (
    SELECT vec_id, row_number() OVER () AS own, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT q.own, q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.own <> c.own
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
