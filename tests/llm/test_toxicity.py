"""Toxicity: segments against their definition, the law of clean texts, held-out accuracy, odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outpoint.llm import toxicity as X

from .conftest import rows_of

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, toxic int"


def by_definition(scores, lo=0, hi=None):
    """The best stretch, then the best ones on either side of it."""
    hi = len(scores) if hi is None else hi
    best = max(((sum(scores[b:e]), b - e, b, e) for b in range(lo, hi) for e in range(b + 1, hi + 1)), default=(0,))
    if best[0] <= 0:
        return []
    total, _, b, e = best
    return [*by_definition(scores, lo, b), (b, e, total), *by_definition(scores, e, hi)]


@pytest.mark.parametrize("seed", range(60))
def test_segments_are_all_maximal_ones(seed):
    draw = np.random.default_rng(seed)
    scores = draw.normal(-0.2, 1, int(draw.integers(0, 40)))
    found = X.maximal_segments(scores)
    expected = by_definition(scores.tolist())
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert [f[2] for f in found] == pytest.approx([e[2] for e in expected])


def test_segments_of_long_sequences_take_linear_time():
    rising = np.tile([1.0, -0.5], 200_000)
    assert X.maximal_segments(rising) == [(0, 399_999, pytest.approx(100_000.5))]
    falling = np.tile([1.0, -1.5], 200_000)
    assert len(X.maximal_segments(falling)) == 200_000
    assert X.maximal_segments(np.zeros(0)) == [] == X.maximal_segments(np.array([-1.0, 0.0]))


def test_law_of_independent_words_gives_uniform_probabilities():
    draw = np.random.default_rng(5)
    values, shares = np.array([-1.0, 1.0, 2.0]), np.array([0.75, 0.2, 0.05])
    rate = X.decay(values, shares)
    assert np.exp(rate * values) @ shares == pytest.approx(1)
    texts = [draw.choice(values, 400, p=shares) for _ in range(1500)]
    best = np.array([max((s for _, _, s in X.maximal_segments(t)), default=0) for t in texts])
    model = X.Model(rate=rate, scale=1500 / (400 * np.exp(-rate * best)).sum())
    p = np.array([model.probability([b], 400) for b in best])
    for level in (0.01, 0.05, 0.2):
        assert (p <= level).mean() == pytest.approx(level, abs=0.03)


def test_more_passages_are_more_evidence():
    model = X.Model(rate=1.0, scale=0.1, prior=0.1)
    one, two = model.probability([9.0], 200), model.probability([9.0, 9.0], 200)
    assert two < one < 0.01 and model.probability([], 200) == 1.0 == model.probability([9.0], 0)
    assert model.score([], 5) == pytest.approx(0.1) and model.score([9.0, 9.0], 200) > model.score([9.0], 200) > 0.1
    assert model.probability([1e6] * 50, 10**7) >= 0 and model.score([1e6], 3) <= 1


def test_counts_equal_plain_counts(spark):
    draw = random.Random(3)
    rows = [(X._packed(np.array(sorted(draw.sample(range(1 << 40), 30) + [5, 7]), np.uint64)), draw.randint(0, 1), draw.choice([1.0, 0.5])) for _ in range(60)]
    expected = {}
    for words, y, weight in rows:
        codes = X._unpacked(words).tolist()
        assert len(codes) == 32
        for cell in {c & (X._CELLS - 1) for c in codes} | {(c >> X.BITS) + X._CELLS for c in codes}:
            pair = expected.setdefault(cell, [0.0, 0.0])
            pair[1 - y] += weight
    df = spark.createDataFrame(rows, "words binary, y int, weight double").repartition(5)
    assert {r.cell: [r.toxic, r.clean] for r in X.word_counts(df).collect()} == expected


def test_words_of_long_texts_are_those_of_short_ones(monkeypatch):
    texts = ["Ab c-d é! " * 500, None, "", "?? !!", "x" * 3000 + " y"]
    whole = [c for _, counts, b, e, c in X.tokens(pa.array(texts)) for c in zip(b.tolist(), e.tolist(), c.tolist(), strict=True)]
    monkeypatch.setattr(X.tb, "BLOCK", 256)
    monkeypatch.setattr(X.tb, "runs", lambda at, f=X.tb.runs: f(at, 256))
    parts = [c for _, counts, b, e, c in X.tokens(pa.array(texts)) for c in zip(b.tolist(), e.tolist(), c.tolist(), strict=True)]
    assert parts == whole and len(whole) == 500 * 4 + 2


def corpus(n, seed=1):
    """Clean texts, and every third with a passage of harsh words; labels for all."""
    draw = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    harsh = ["vile", "rotten", "foul", "nasty"]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(80)]
        if i % 3 == 0:
            words[40:40] = draw.sample(harsh, 4)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    return docs, labels


def test_passages_are_found_where_they_are(spark, documents):
    docs, labels = corpus(1200)
    model = X.train(documents(docs), spark.createDataFrame(labels, LABELS))
    fresh, known = corpus(90, seed=2)
    fresh = [(i, "É " + t) for i, t in fresh]
    texts, wanted = dict(fresh), dict(known)
    for r in X.score_toxicity(documents(fresh), model).collect():
        assert r.predicted == wanted[r.doc_id] == int(r.score >= 0.7)
        if r.predicted:
            (p,) = r.passages
            words = texts[r.doc_id][p.begin : p.end].split()
            assert {"vile", "rotten", "foul", "nasty"} <= set(words) and len(words) <= 6 and p.expected <= X.ALPHA


def test_copies_of_one_text_do_not_make_its_words_toxic(spark, documents):
    docs, labels = corpus(600)
    family = "some odd story about a quux and a frob that many pages share with each other "
    docs += [(1000 + i, family * 3 + f"tail{i}") for i in range(200)]
    labels += [(1000 + i, 1) for i in range(200)]
    model = X.train(documents(docs), spark.createDataFrame(labels, LABELS))
    found = X.score_toxicity(documents([(1, "a quux and a frob in a clean text"), (2, "vile rotten foul nasty")]), model)
    assert rows_of(found, "doc_id", "predicted") == [(1, 0), (2, 1)]


def test_one_word_repeated_is_one_word(spark):
    model = X.Model(rate=1.0, scale=0.01, prior=0.1)
    model.odds[:] = 1.5
    codes = np.full(500, 77, np.uint64)
    assert sum(s for _, _, s in X.maximal_segments(model.values(codes))) == pytest.approx(1.4)
    two = model.values(np.full(6, 77, np.uint64), np.array([0, 3, 6]))
    assert two.tolist() == pytest.approx([1.4, -0.1, -0.1, 1.4, -0.1, -0.1])


def test_held_out_documents(spark):
    found = X.op12_toxicity(spark, SF).toPandas()
    both = found.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93 and held[held.toxic == 0].predicted.mean() < 0.02
    assert found.score.between(0, 1).all() and len(found) == 1000
    assert ((found.score >= 0.7) == (found.predicted == 1)).all()


def test_odd_rows_and_labels(spark, documents):
    docs = documents([(1, None), (2, ""), (2, "twice here"), (None, "no id"), (4, "word " * 60_000), (5, "?!")])
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0), (2, 7), (4, 0), (4, 1)], LABELS)
    clashing = docs.withColumns({"score": F.lit("x"), "passages": F.lit(1), "words": F.lit(2), "y": F.lit(0)})
    found = X.score_toxicity(clashing, X.train(clashing, labels)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 and r.passages == [] for r in found)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in X.score_toxicity(docs, X.train(docs, none)).collect()} == {0.5}
    assert X.score_toxicity(documents([]), X.train(documents([]), labels)).count() == 0
    clean = X.train(docs, spark.createDataFrame([(2, 0), (4, 0)], LABELS))
    assert {r.predicted for r in X.score_toxicity(docs, clean).collect()} == {0} and clean.prior < 0.5
    assert math.isfinite(clean.rate)
