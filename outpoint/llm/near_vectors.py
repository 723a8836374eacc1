"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits the unit vectors at the median of their projection on a random
direction, again and again. Vectors close to a median go to both sides (spill
overlap), so that a close pair is rarely torn apart, and many trees make what
one tears likely to meet in another. The splits are fitted on a bounded
sample; every vector then walks all trees, as deep as the number of vectors
of its label asks for. Within a leaf all pairs of one label are compared
exactly. A pair that meets in several leaves counts in the first one only,
which either side can tell from the leaves of both. Leaves return counts and
a spanning star per local component, never pairs, and components are united
over all leaves. A leaf that is still large, such as many copies, is dealt
into blocks and each pair of blocks is compared by itself, so nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, written
from .components import components

THRESHOLD = 0.93
TREES = 6
#: Rows to fit the trees on, expected number; nodes with fewer of them than LEAST_SAMPLE are not split.
SAMPLE = 1 << 14
LEAST_SAMPLE = 32
#: Rows that a leaf should have, and rows of a block of a larger leaf.
LEAF_ROWS = 512
BLOCK_ROWS = 2048
#: Half width of the overlap, in typical projections of the difference of a pair at the threshold.
SPILL = 0.5
SEED = 20240229


class Forest:
    """Directions, medians and overlap of all inner nodes, in the order 0, children of n at 2n+1 and 2n+2."""

    def __init__(self, sample: np.ndarray, levels: int, threshold: float) -> None:
        draw = np.random.Generator(np.random.PCG64(SEED))
        dims = max(1, sample.shape[1])
        self.dims, self.levels = dims, levels
        self.margin = SPILL * np.sqrt(2 * (1 - threshold) / dims)
        nodes = (1 << levels) - 1
        self.directions = draw.normal(size=(TREES, nodes, dims)).astype(np.float32)
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.medians = np.full((TREES, nodes), np.nan)
        for tree in range(TREES):
            held = {0: sample}
            for node in range(nodes):
                rows = held.pop(node, None)
                if rows is None or len(rows) < LEAST_SAMPLE:
                    continue
                along = rows @ self.directions[tree, node]
                median = self.medians[tree, node] = np.median(along)
                held[2 * node + 1], held[2 * node + 2] = rows[along <= median], rows[along > median]

    def leaves(self, units: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of every place that a vector gets; leaves of different trees differ."""
        out_rows, out_leaves = [], []
        base = 2 << self.levels
        for tree in range(TREES):
            rows, nodes = np.arange(len(units)), np.zeros(len(units), np.int64)
            for level in range(self.levels + 1):
                inner = nodes < len(self.medians[tree])
                median = np.full(len(nodes), np.nan)
                median[inner] = self.medians[tree, nodes[inner]]
                stop = (level >= depths[rows]) | np.isnan(median)
                out_rows.append(rows[stop])
                out_leaves.append(tree * base + nodes[stop])
                rows, nodes, median = rows[~stop], nodes[~stop], median[~stop]
                along = np.einsum("ij,ij->i", units[rows], self.directions[tree, nodes])
                left, right = along <= median + self.margin, along > median - self.margin
                rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def unit_rows(vectors, dims: int | None = None) -> np.ndarray:
    """Vectors as double rows of length 1; shorter ones are filled up with zeros, longer ones cut, to ``dims``."""
    vectors = [np.asarray(v, np.float64) for v in vectors]
    width = len(vectors[0]) if dims is None else dims
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    largest = np.abs(out).max(axis=1, initial=0, keepdims=True)
    out /= np.where(largest > 0, largest, 1)  # so that squares neither vanish nor overflow
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _place(shared):
    """Each vector once per leaf, with all its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(batch.column(4).to_pylist(), forest.dims)
            rows, leaves = forest.leaves(units, batch.column(5).to_numpy(zero_copy_only=False))
            order = np.lexsort((leaves, rows))
            rows, leaves = rows[order], leaves[order]
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            every = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(leaves, pa.int64()))
            at = pa.array(rows)
            columns = [*(batch.column(i).take(at) for i in range(5)), pa.array(leaves, pa.int64()), every.take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "vec_id", "label", "dims", "v", "leaf", "leaves"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest common number of two rows of sorted numbers (filled with -1 and -2), row by row."""
    out = np.full(len(a), -1)
    for c in range(a.shape[1] - 1, -1, -1):
        has = (b == a[:, c : c + 1]).any(1)
        out[has] = a[has, c]
    return out


def _filled(lists, fill: int) -> np.ndarray:
    width = max(len(x) for x in lists)
    out = np.full((len(lists), width), fill, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _compare(threshold: float):
    """Links found in one leaf, or pair of blocks of it: per vector their number and the smallest of its component."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, lo, hi = int(key[2]), int(key[3]), int(key[4])
        units = unit_rows(pdf["v"])
        left = np.flatnonzero(pdf["own"].to_numpy() == lo)
        right = np.flatnonzero(pdf["own"].to_numpy() == hi)
        mine, theirs = _filled(pdf["leaves"].tolist(), -1), _filled(pdf["leaves"].tolist(), -2)
        ids = pdf["vec_id"].to_numpy(np.int64)
        count = np.zeros(len(pdf), np.int64)
        links = []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(units[rows] @ units[right].T >= threshold)
            i, j = rows[i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 1 << 17):
                a, b = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
                here = _first_shared(mine[a], theirs[b]) == leaf
                count += np.bincount(a[here], minlength=len(pdf)) + np.bincount(b[here], minlength=len(pdf))
                links.append((a[here], b[here]))
        a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
        root = ids.copy()
        while len(a):
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (root == before).all():
                break
        linked = count > 0
        return pd.DataFrame({"uid": pdf["uid"][linked], "vec_id": ids[linked], "n": count[linked], "root": root[linked]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine is
    ``threshold`` or more. Vectors that are null, empty, zero, hold a null or
    non-finite component or have no vec_id link with nothing; so do vectors of
    different length. Rows that repeat a vec_id are compared as rows and are
    one node of a component. Without vec_id, component_id and kept are null.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 4096)
    value = F.col("embedding")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    usable = F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    base = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.size("embedding").alias("dims"),
        F.when(usable, value).alias("v"),
    )
    base = written(base, "vectors")
    real = base.filter("v IS NOT NULL")
    sizes = written(real.groupBy("label", "dims").agg(F.count("*").alias("n")), "sizes")
    top = sizes.agg(F.max("n"), F.sum("n"), F.max("dims")).first()
    if not top[0]:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    share = min(1.0, SAMPLE / top[1])
    drawn = real.filter(F.pmod(F.xxhash64(F.lit(3), "uid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = unit_rows([*drawn.select("v").toPandas()["v"], np.zeros(top[2])], top[2])[:-1]
    deepest = max(0, int(np.log2(max(1, SAMPLE // LEAST_SAMPLE))))
    levels = min(deepest, max(0, int(np.ceil(np.log2(max(1.0, top[0] / LEAF_ROWS))))))
    forest = spark.sparkContext.broadcast(Forest(sample, levels, threshold))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(LEAF_ROWS)))).cast("int")
    deep = real.join(sizes.select("label", "dims", depth.alias("depth")), ["label", "dims"])
    kind = dict(base.dtypes)["v"]
    placed = deep.select("uid", "vec_id", "label", "dims", "v", "depth").mapInArrow(
        _place(forest), f"uid long, vec_id long, label string, dims int, v {kind}, leaf long, leaves array<long>"
    )
    placed = written(placed, "placed")
    large = placed.groupBy("label", "dims", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")).filter("blocks > 1")
    large = written(large, "large-leaves")
    dealt = placed.join(large, ["label", "dims", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    found = dealt.groupBy("label", "dims", "leaf", "lo", "hi").applyInPandas(_compare(threshold), "uid long, vec_id long, n long, root long")
    found = written(found, "links")
    parts = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("uid").agg(F.sum("n").alias("n_links"))
    named = base.select("uid", "vec_id").join(counts, "uid", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op3_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


OP3_SQL = """
WITH RECURSIVE
sound AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
),
parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT p.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM parts p LEFT JOIN counts c USING (vec_id)
"""
