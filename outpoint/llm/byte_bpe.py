"""Byte-level BPE by replaying the merges over all distinct words of a block of the corpus.

A rank file gives every token a rank. Words (the matches of the pattern) do
not influence each other, so the distinct words of a block are encoded
together: an inverted index leads from a pair of neighbouring tokens to the
positions where it stands, and merges are applied in rank order, lowest
first, each at all its positions from left to right. A merge touches only its
two neighbours, whose pairs enter the index. Should a new pair rank below the
merge in hand, that pair goes first, as in a word-by-word encoder. Texts are
then put together from their words, and decoded from the ids alone.

A task keeps the words it has encoded for the next block, up to a bound, and
forgets them at its end: the worker that ran it may serve other stages.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, table, texts_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Words that are encoded together; more than fit in a processor's cache are slower.
BLOCK_WORDS = 1 << 12
#: Encoded words that a task keeps.
KEPT_WORDS = 1 << 18


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every token of a rank file, by rank."""
    with open(path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


class Merges:
    """The merges of one rank file."""

    def __init__(self, path: str) -> None:
        self.parts = token_bytes(path)
        self.ranks = {token: rank for rank, token in self.parts.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.base = max(self.parts) + 1
        # Every pair of neighbours that makes a token, as one number, with the token's rank.
        self.pairs = {
            self.ranks[token[:cut]] * self.base + self.ranks[token[cut:]]: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        }
        self.words: dict[str, bytes] = {}

    def replay(self, words: Iterable[bytes]) -> list[list[int]]:
        """Token ids of each word; a word that is a token as a whole is that token."""
        pair_rank, base, single = self.pairs.get, self.base, self.single
        ids: list[int] = []
        after: list[int] = []
        starts = []
        index: defaultdict[int, list[int]] = defaultdict(list)
        for word in words:
            at = len(ids)
            starts.append(at)
            if word in self.ranks:
                ids.append(self.ranks[word])
                after.append(-1)
                continue
            mine = [single[b] for b in word]
            ids += mine
            after += range(at + 1, at + len(mine))
            if mine:
                after.append(-1)
            for i, (left, right) in enumerate(pairwise(mine), at):
                rank = pair_rank(left * base + right)
                if rank is not None:
                    index[rank].append(i)
        before = list(range(-1, len(ids) - 1))
        for at in starts:
            if at < len(ids):
                before[at] = -1
        waiting = list(index)
        heapify(waiting)
        while waiting:
            rank = heappop(waiting)
            places = index.pop(rank, ())
            if len(places) > 1:
                places.sort()
            for n, i in enumerate(places):
                j = after[i]
                if j < 0 or ids[i] < 0 or pair_rank(ids[i] * base + ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                lower = False
                if k >= 0:
                    before[k] = i
                    new = pair_rank(rank * base + ids[k])
                    if new is not None:
                        if new not in index:
                            heappush(waiting, new)
                        index[new].append(i)
                        lower = new < rank
                h = before[i]
                if h >= 0:
                    new = pair_rank(ids[h] * base + rank)
                    if new is not None:
                        if new not in index:
                            heappush(waiting, new)
                        index[new].append(h)
                        lower |= new < rank
                if lower:  # that pair goes first; the other places wait
                    if n + 1 < len(places):
                        if rank not in index:
                            heappush(waiting, rank)
                        index[rank] += places[n + 1 :]
                    break
        out = []
        for start in starts:
            word, i = [], start
            while 0 <= i < len(ids):
                word.append(ids[i])
                i = after[i]
            out.append(word)
        return out

    def encode(self, texts: list[str], pattern) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        split = [pattern.findall(text) for text in texts]
        new = list(set(chain.from_iterable(split)).difference(self.words))
        for at in range(0, len(new), BLOCK_WORDS):
            block = new[at : at + BLOCK_WORDS]
            for word, ids in zip(block, self.replay([w.encode() for w in block]), strict=True):
                self.words[word] = np.array(ids, "<u4").tobytes()
        for words in split:
            yield b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def _pattern(pattern: str):
    return regex.compile(pattern)


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids of documents (doc_id, text).

    ``ids`` is binary, a little-endian unsigned 32-bit number per token of the
    whole text. Null and empty texts have no tokens; repeated rows and rows
    without doc_id are encoded like any other; other columns are ignored.
    ``ranks`` must be readable under that path on every executor.
    """
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        ids = list(merges(ranks).encode(texts_of(batch), _pattern(pattern)))
        return {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, ids binary", lambda: merges(ranks).words.clear())


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids and the bytes they stand for, as ``decoded``. Null ids stay null."""

    def run(batch: pa.RecordBatch) -> dict:
        part = token_bytes(ranks).__getitem__
        decoded = [None if x is None else b"".join(map(part, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "ids": batch.column(1), "decoded": pa.array(decoded, pa.binary())}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """Token counts and checksums of the ids and of what they decode to."""
    both = decode(encode(docs))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
