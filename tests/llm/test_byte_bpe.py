"""Byte-level BPE against tiktoken and as an exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from outpoint.llm import byte_bpe as B


@pytest.fixture(scope="module")
def library():
    with open(B.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None,
    "",
    "The the  THE\n\n\tthat's 1234567 ... --- it'll",
    "<|endoftext|> é 日本語 \U0001f600 \x00\x01 ́",
    "a" * 3000 + " " * 500 + "ab" * 700,
    "".join(chr(c) for c in range(32, 2000, 7)),
]


def test_equals_library(documents, library):
    found = {r.doc_id: r for r in B.digests(documents(list(enumerate(TEXTS))), "decoded").collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(found[i].decoded) == (text or "").encode()


def test_random_words_replayed_together(library):
    random.seed(3)
    words = ["".join(random.choice("aehinorst éü!#") for _ in range(random.randint(1, 24))).encode() for _ in range(3000)]
    known = B.Merges(B.RANKS)
    assert known.replay(words) == [library._core_bpe.encode_single_piece(w) for w in words]


def test_a_lower_rank_that_a_merge_opens_goes_first(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"cd": 299, b"abcd": 260, b"xab": 270, b"abx": 280}
    path = tmp_path / "small"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    core = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    words = [b"abab", b"xabab", b"xabx", b"abcdab", b"ababxab", b"cdcdab", b"aabbccdd", b"abxabcdxab"]
    assert B.Merges(str(path)).replay(words) == [core.encode_single_piece(w) for w in words]


def test_bounded_memory_of_words(library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 5)
    known = B.Merges(B.RANKS)
    pattern = B._pattern(public_tokenizers.PATTERN)
    for text in ["one two three four five six seven", "one two", "eight nine one"]:
        assert np.frombuffer(next(known.encode([text], pattern)), "<u4").tolist() == library.encode_ordinary(text)


def test_repeated_and_missing_ids(documents):
    docs = documents([(1, "x"), (1, "x"), (None, "y")]).withColumnRenamed("source", "ids")
    assert sorted(str(r.doc_id) for r in B.digests(docs).collect()) == ["1", "1", "None"]
    assert B.digests(documents([])).count() == 0
    assert B.decode(docs.sparkSession.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()[0].decoded is None


def test_a_task_forgets_its_words(spark, documents):
    docs = documents([(i, f"some words {i} and others") for i in range(200)]).repartition(1)

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(B.merges(B.RANKS).words)] * batch.num_rows)})

    assert B.encode(docs).count() == 200
    kept = spark.range(40).repartition(8).mapInArrow(left, "n long")
    assert {r.n for r in kept.collect()} == {0}
