"""Quality scores: held-out accuracy, statistics, odd inputs."""

import numpy as np
import pyarrow as pa
import pytest

from outpoint.llm import quality as Q

from .conftest import rows_of

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = Q.op4_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.95
    assert found.score.between(0, 1).all() and len(found) == 1000
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_statistics_follow_the_whole_text(monkeypatch):
    texts = ["a b a b c\nd", None, "", "A!", "x " * 5000 + "END", "é|é"]
    plain = Q.statistics(pa.array(texts))
    assert np.isfinite(plain).all() and not plain[1].any() or plain[1, 0] == 0
    assert plain[0, 1] == pytest.approx(4 / 6) and plain[0, 2] == pytest.approx(2 / 6)
    monkeypatch.setattr(Q.tb, "BLOCK", 64)
    assert np.allclose(Q.statistics(pa.array(texts)), plain)


def test_isotonic_is_the_closest_rising_sequence():
    values = np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8])
    found = Q.isotonic(values, np.array([1, 1, 1, 2, 1, 3.0]))
    assert (np.diff(found) >= 0).all()
    assert found == pytest.approx([0.1, 0.35, 0.35, 0.35, 0.825, 0.825])


def test_sums_over_partitions_equal_one_solve(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(0, 1, (200, Q.N_STATISTICS))
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(7)
    model = Q.train(rows)
    phi = model.features(x)
    penalty = np.diag(np.append(np.full(Q.FEATURES, Q.RIDGE * len(x)), 0) + 1e-9)
    assert np.allclose(model.weights, np.linalg.solve(phi.T @ phi + penalty, phi.T @ y), atol=1e-5)


def test_kernel_approximates_a_gaussian():
    draw = np.random.default_rng(4)
    model = Q.Model(np.zeros(Q.N_STATISTICS), np.ones(Q.N_STATISTICS))
    x = draw.normal(0, 0.6, (40, Q.N_STATISTICS))
    phi = model.features(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(2)
    exact = np.exp(-distance / (2 * Q.WIDTH**2 * Q.N_STATISTICS))
    assert np.abs(phi @ phi.T - exact).mean() < 0.06


def test_odd_rows_and_labels(spark, documents):
    docs = documents([(1, None), (2, ""), (2, "twice here"), (None, "no id"), (4, "word " * 60_000)])
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0), (2, 7)], "doc_id long, quality int")
    found = Q.score_quality(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rows_of(Q.score_quality(docs, none), "score", "predicted") == [(0.5, 1)] * 5
    assert Q.score_quality(documents([]), labels).count() == 0
    one_class = spark.createDataFrame([(4, 0), (2, 0), (3, 0), (1, 0)], "doc_id long, quality int")
    assert {r.predicted for r in Q.score_quality(docs, one_class).collect()} == {0}
