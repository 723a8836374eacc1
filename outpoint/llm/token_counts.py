"""Token counts of whole texts, huge ones encoded in overlapping chunks.

The vocabulary's splitter drops white space, and no token, special string,
normalization or contraction reaches over it. So a position after white space
where a token starts is a boundary whatever stands before: it is stable. A
huge text is cut into chunks that overlap, spread over tasks, and encoded
with offsets. Neighbours are spliced at the first stable boundary that both
encodings have inside the overlap: the left one counts up to it, the right
one from it. Where they share none, the overlap is widened to both whole
chunks, which are encoded as one, until all neighbours align.

Texts up to one chunk are encoded piece by piece between white space, which
the same argument allows; a task keeps the counts of pieces it has met.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, table, texts_of, written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Characters of a chunk without its overlap, and of the overlap with the next one.
CHUNK = 1 << 15
OVERLAP = 512
#: Pieces whose counts a task keeps, and the longest piece that it keeps.
KEPT_PIECES = 1 << 19
LONGEST_KEPT = 64
LIMIT = 2048

_BLANKS = " \n\t\r"
_TO_SPACE = str.maketrans(_BLANKS, " " * len(_BLANKS))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def _kept(path: str) -> dict[str, int]:
    return {"": 0}


def count_pieces(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, from its pieces between white space."""
    kept = _kept(path)
    if len(kept) > KEPT_PIECES:
        kept.clear()
        kept[""] = 0
    split = [text.translate(_TO_SPACE).split(" ") for text in texts]
    new = list({piece for pieces in split for piece in pieces if piece not in kept})
    encoded = tokenizer(path).encode_batch_fast(new, add_special_tokens=False)
    fresh = {piece: len(e) for piece, e in zip(new, encoded, strict=True)}
    kept.update((piece, n) for piece, n in fresh.items() if len(piece) <= LONGEST_KEPT)
    return [sum(kept[p] if p in kept else fresh[p] for p in pieces) for pieces in split]


def stable(text: str, start: int, starts: list[int], lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Places (in the whole text) in ``lo..hi`` of the chunk where a token starts after white space, and the tokens before."""
    places, before = [], []
    for n, at in enumerate(starts):
        if lo <= at < hi and at > 0 and text[at - 1] in _BLANKS and text[at] not in _BLANKS:
            if not places or places[-1] != at + start:
                places.append(at + start)
                before.append(n)
    return places, before


_CHUNK = "key string, doc_id long, n_bytes long, n_tokens long, chunk long, start long, overlap long, text string"
_SPLICE = "key string, doc_id long, n_bytes long, chunk long, start long, overlap long, text string, n long, head array<long>, head_before array<long>, tail array<long>, tail_before array<long>"


def _first_pass(path: str, chunk: int, overlap: int):
    """A row with the count for each text up to a chunk, rows with chunks for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _CHUNK.split(", ")]
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            counts = iter(count_pieces([t for t in texts if len(t) <= chunk], path))
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                key, size = f"{task}-{number}", len(text.encode())
                number += 1
                if len(text) <= chunk:
                    rows.append((key, doc_id, size, next(counts), None, None, None, None))
                    continue
                for i, at in enumerate(range(0, len(text), chunk)):
                    rows.append((key, doc_id, size, None, i, at, overlap, text[at : at + chunk + overlap]))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _encode_chunks(path: str, chunk: int):
    def run(batch: pa.RecordBatch) -> dict:
        out = {name: batch.column(batch.schema.get_field_index(name)) for name in ("key", "doc_id", "n_bytes", "chunk", "start", "overlap", "text")}
        more: dict[str, list] = {"n": [], "head": [], "head_before": [], "tail": [], "tail_before": []}
        for text, start, overlap in zip(out["text"].to_pylist(), out["start"].to_pylist(), out["overlap"].to_pylist(), strict=True):
            starts = [o[0] for o in tokenizer(path).encode(text, add_special_tokens=False).offsets]
            head = stable(text, start, starts, 1, overlap)
            tail = stable(text, start, starts, max(1, len(text) - overlap), len(text))
            for name, value in zip(more, (len(starts), *head, *tail), strict=True):
                more[name].append(value)
        kinds = {"n": pa.int64()}
        return out | {name: pa.array(value, kinds.get(name, pa.list_(pa.int64()))) for name, value in more.items()}

    return run


def count_tokens(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of documents (doc_id, text), a row per row.

    Counts are those of the vocabulary's library for the whole text without
    added begin or end tokens. Null and empty texts have no bytes and no
    tokens; rows without doc_id or with a repeated one are counted like any
    other; other columns are ignored. ``path`` must be readable on every
    executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(texts.mapInArrow(_first_pass(path, chunk, overlap), _CHUNK), "first-pass")
    done = first.filter("chunk IS NULL").select("doc_id", "n_bytes", "n_tokens")
    chunks = first.filter("chunk IS NOT NULL").drop("n_tokens").repartition("key", "chunk")
    spliced: DataFrame | None = None
    while not chunks.isEmpty():
        encoded = written(map_batches(chunks, _encode_chunks(path, chunk), _SPLICE), "chunks")
        if spliced is not None:
            encoded = spliced.unionByName(encoded)
        order = Window.partitionBy("key").orderBy("chunk")
        near = encoded.withColumn("next", F.lead("head").over(order)).withColumn("next_before", F.lead("head_before").over(order))
        place = F.array_min(F.array_intersect("tail", "next"))
        last = F.col("next").isNull()
        left = F.element_at("tail_before", F.array_position("tail", place).cast("int"))
        right = F.element_at("next_before", F.array_position("next", place).cast("int"))
        known = near.withColumn("place", place).withColumn("aligned", last | place.isNotNull())
        counted = known.withColumn("part", F.when(last, F.col("n")).when(F.col("place").isNotNull(), left - right))
        columns = [c.split()[0] for c in _SPLICE.split(", ")]
        counted = written(counted.select(*columns, "aligned", "part"), "aligned")
        open_keys = written(counted.filter("NOT aligned").select("key").distinct(), "open")
        closed = counted.join(open_keys, "key", "left_anti")
        sums = closed.groupBy("key", "doc_id", "n_bytes").agg(F.sum("part").alias("n_tokens"))
        done = done.union(sums.select("doc_id", "n_bytes", "n_tokens"))
        waiting = counted.join(open_keys, "key", "left_semi")
        # Runs of neighbours that do not align become one chunk each, without the repeated overlap.
        behind = F.lag("aligned").over(order)
        run = F.sum(F.when(F.coalesce(behind, F.lit(True)), 1).otherwise(0)).over(order)
        runs = written(waiting.withColumn("run", run).withColumn("size", F.count("*").over(Window.partitionBy("key", "run"))), "runs")
        spliced = runs.filter("size = 1").select(*columns)
        pieces = F.sort_array(F.collect_list(F.struct("chunk", "overlap", "text")))
        fresh = F.transform(pieces, lambda p, i: F.when(i == 0, p["text"]).otherwise(p["text"].substr(p["overlap"] + 1, F.length(p["text"]))))
        joined = F.array_join(fresh, "")
        chunks = runs.filter("size > 1").groupBy("key", "doc_id", "n_bytes", "run").agg(
            F.min("chunk").alias("chunk"), F.min("start").alias("start"), F.max("overlap").alias("overlap"), joined.alias("text")
        ).drop("run")
        chunks = written(chunks, "widened")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"))
