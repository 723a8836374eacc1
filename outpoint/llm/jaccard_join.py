"""Set similarity join of documents on word shingles, light and heavy sets apart.

Sets are compared through a total order of all shingles, rare ones first. Two
sets that link share at least ``c`` elements among their first
``n - need(n) + c``, where ``need(n)`` is the least overlap that a set of
``n`` can link with. Light sets (at most ``boundary`` shingles) enumerate all
subsets of two elements of that prefix (c = 2); heavy sets write each element
of the shorter prefix (c = 1) to its inverted list, which is then scanned.
Light sets that are large enough to link with a heavy one do both. The
boundary is the size with the least cost: subsets written against lists
scanned, from the sizes and frequencies of the corpus.

Keys travel packed in inverted lists, see ``lists``, and equal sets of a task
are sent once. Components are needed, not all pairs, so a large group of
copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lists
from . import textbytes as tb
from .common import bounded_batches, table, written

#: Shingles that a task counts at once.
COUNT_KEYS = 1 << 21
#: The order knows the frequency of so many shingles, the most frequent ones (a table of 4 MB).
FREQUENT = 1 << 18
#: Distinct sets that a task remembers.
REMEMBERED = 1 << 19
#: Sizes among which the boundary is chosen.
BOUNDARIES = (0, 4, 8, 12, 16, 24, 32, 48, 64)

#: Similarity of 3/4 or more.
LEAST, OF = 3, 4


def need(n):
    """Least overlap with a set of ``n`` in a pair that links."""
    return (LEAST * n + OF - 1) // OF


def _sizes_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (doc_id, n), and the shingles met at least three times by a task (shingle, n)."""
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= 3
        return rows(None, values[often].view(np.int64), counts[often])

    def rows(ids, hashes, n) -> pa.RecordBatch:
        empty = pa.nulls(len(n), pa.int64())
        columns = [empty if ids is None else ids, empty if hashes is None else pa.array(hashes), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(n), ids is not None))], ["doc_id", "shingle", "n", "is_doc"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ns = np.zeros(batch.num_rows, np.int64)
        for first, at, hashes in tb.shingle_sets(batch.column(1)):
            ns[first : first + len(at) - 1] = np.diff(at)
            held.append(hashes)
            size += len(hashes)
            if size >= COUNT_KEYS:
                yield counted()
                held, size = [], 0
        yield rows(batch.column(0), None, ns)
    if size:
        yield counted()


def _subset_keys(rows: np.ndarray, hashes: np.ndarray, place: np.ndarray, size: np.ndarray, boundary: int):
    """Keys of all two-element subsets of the prefixes of light sets."""
    light = (size <= boundary) & (size >= 2) & (place < size - need(size) + 2)
    rows, hashes, place = rows[light], hashes[light], place[light]
    out_rows, out_keys = [], []
    for step in range(1, boundary - need(boundary) + 2):
        i = np.arange(len(rows) - step)
        i = i[rows[i] == rows[i + step]]
        out_rows.append(rows[i])
        out_keys.append(tb.mixed(tb.mixed(hashes[i]) * tb.STEPS[8] + tb.mixed(hashes[i + step]) * tb.STEPS[9]))
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out_keys)


def keys_of(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, frequent, boundary: int):
    """(row, key) of the sets in a block, sorted by row and hash; ``sizes`` is by row."""
    values, counts = frequent
    freq = np.zeros(len(hashes), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        freq = np.where(values[at] == hashes, counts[at], 0)
    # Sets come in the order of their hashes, so a stable sort by row and frequency is enough.
    order = np.argsort(rows * (int(freq.max(initial=0)) + 1) + freq, kind="stable")
    rows, hashes = rows[order], hashes[order]
    size = sizes[rows]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    few_rows, few_keys = _subset_keys(rows, hashes, place, size, boundary)
    # A light set links with a heavy one only from 3/4 of the first heavy size on; a single element has no subset.
    listed = (place < size - need(size) + 1) & ((OF * size >= LEAST * (boundary + 1)) | (size == 1))
    all_rows = np.concatenate([few_rows, rows[listed]])
    return all_rows, np.concatenate([few_keys, tb.mixed(hashes[listed])])


def _send(frequent: Broadcast, boundary: int, buckets: int):
    """Packed keys per bucket, and links from copies to the first equal set that the task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        copies: list[tuple[int, int]] = []

        def sent() -> pa.RecordBatch:
            parts = held or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            return lists.pack(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets, copies)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            for first, at, hashes in tb.shingle_sets(batch.column(1)):
                sizes = np.diff(at)
                fresh = np.zeros(len(sizes), bool)
                for r in np.flatnonzero(sizes):
                    key, doc = hashes[at[r] : at[r + 1]].tobytes(), ids[first + int(r)].as_py()
                    if doc is None:
                        continue
                    kept = seen.setdefault(blake2b(key, digest_size=16).digest(), doc)
                    fresh[r] = kept == doc
                    if kept != doc:
                        copies.append((doc, kept))
                rows = np.repeat(np.arange(len(sizes)), sizes)
                use = fresh[rows]
                mine, keys = keys_of(rows[use], hashes[use], sizes, frequent.value, boundary)
                doc_ids = np.array([x if x is not None else 0 for x in ids.slice(first, len(sizes)).to_pylist()], np.int64)
                held.append((doc_ids[mine], sizes[mine], keys))
                size += len(keys)
                if size >= lists.SEND_KEYS:
                    yield sent()
                    held, size, copies = [], 0, []
                if len(seen) > REMEMBERED:
                    seen.clear()
        if held or copies:
            yield sent()

    return run


def _bodies(wanted: np.ndarray, pack):
    """Texts of documents that may be asked for, as ``pack`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0)
                use = pa.array(lists.in_filter(wanted, ids.to_numpy(zero_copy_only=False)))
                texts = [pack(t.encode()) for t in batch.column(1).filter(use).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.filter(use), pa.array(texts, pa.binary())], ["id", "body"])

    return run


def _shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the sets of texts."""
    found = [(first, at, hashes) for first, at, hashes in tb.shingle_sets(pa.array(texts, pa.large_binary()))]
    rows = [np.repeat(np.arange(first, first + len(at) - 1), np.diff(at)) for first, at, _ in found]
    return np.concatenate(rows), np.concatenate([hashes for _, _, hashes in found])


def choose_boundary(sizes: DataFrame, load: float) -> int:
    """The boundary with the least cost; ``load`` is the expected length of a scanned list."""
    n = F.col("n")
    short = n - F.floor((LEAST * n + OF - 1) / OF)
    subsets = (short + 2) * (short + 1) / 2
    lists = (short + 1) * F.lit(1.0 + load)
    cost = [F.sum(F.when(n <= x, subsets).otherwise(lists) + F.when((n <= x) & (OF * n >= LEAST * (x + 1)), lists).otherwise(0.0)) for x in BOUNDARIES]
    costs = sizes.filter("n > 1").agg(*cost).first()
    return min(zip((c or 0.0 for c in costs), BOUNDARIES, strict=True))[1]


def jaccard_join(docs: DataFrame, boundary: int | None = None) -> DataFrame:
    """Documents (doc_id, text) with the size of their set and their component.

    A set has the distinct five-word shingles of the whole text, words being
    runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased; fewer words
    are one shingle. Sets link when their Jaccard similarity is 0.75 or more.
    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by
    links, itself included), one row per row of ``docs``.

    Null and empty texts have an empty set and link with nothing. Rows that
    repeat a doc_id are one node with a set each; a row without doc_id gets
    its size and a null component. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(texts.mapInArrow(_sizes_and_counts, "doc_id long, shingle long, n long, is_doc boolean"), "sizes")
    sizes = first.filter("is_doc").select("doc_id", "n")
    totals = sizes.agg(F.sum("n"), F.sum(F.when(F.col("n") > 0, F.col("n") / 4 + 1))).first()
    common = first.filter("NOT is_doc").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = common.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    values = top["shingle"].to_numpy().view(np.uint64)
    counts = top["n"].to_numpy()
    order = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[order], counts[order]))
    load = float((counts.astype(float) ** 2).sum()) / max(1, totals[0] or 0)
    if boundary is None:
        boundary = choose_boundary(sizes, load)
    buckets = lists.bucket_count(totals[1] or 0)

    sent = texts.mapInArrow(_send(frequent, boundary, buckets), lists.PACKED)
    known = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def bodies(wanted: np.ndarray, pack) -> DataFrame:
        return known.mapInArrow(_bodies(wanted, pack), "id long, body binary")

    parts = lists.list_components(sent, bodies, _shingles_of, LEAST, OF, again=True)
    named = sizes.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest doc_id.

    All columns and rows stay for what is kept; documents without doc_id stay.
    """
    found = jaccard_join(docs)
    gone = written(found.filter("component_id < doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"))


OP8_SQL = r"""
WITH RECURSIVE
words AS (
    SELECT doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN w IS NULL OR len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM words
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
firsts AS (
    SELECT doc_id, n, item
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, item) AS place
          FROM (SELECT *, count(*) OVER (PARTITION BY item) AS df FROM items))
    WHERE place <= n - (3 * n + 3) // 4 + 1
),
pairs AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
    FROM firsts a JOIN firsts b ON a.item = b.item AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
),
links AS (
    SELECT a, b FROM (
        SELECT p.a, p.b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS total
        FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b)
    WHERE 100 * i >= 75 * (total - i)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
