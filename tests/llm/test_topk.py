"""Exact top-k against brute force."""

import numpy as np
from pyspark.sql import functions as F

from outpoint.llm import topk as T

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=5, every=50):
    whole = []
    for vec_id, v, *_ in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for n, (q, v) in enumerate(whole):
        if q % every == 0:
            others = [(i, w) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v)]
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in others]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, rows, k=5):
    df = T.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, k)
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 60)
    monkeypatch.setattr(T, "LEAF_ROWS", 7)
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(0, 0.2, 6)], 1, None) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6, 1, None) for i in range(150)]  # one vector many times: ties
    rows += [(50, [0.5] * 6, 1, None), (50, rows[7][1], 1, None), (3, rows[3][1], 1, None)]  # ids that repeat
    assert found(spark, rows) == brute(rows)


def test_scores_beyond_64_bits(spark, monkeypatch):
    """They count as the nearest value that a score can have, ties go to smaller ids."""
    monkeypatch.setattr(T, "SHARD_ROWS", 6)
    monkeypatch.setattr(T, "LEAF_ROWS", 2)
    rows = [(i, [(-1) ** i * 1e12, float(i)], 1, None) for i in range(0, 120, 5)]
    rows += [(200 + i, [1e38, -1e38], 1, None) for i in range(4)] + [(250, [-1e15, 3.0], 1, None), (7, [0.5, 0.5], 1, None)]
    expected = brute(rows, k=40)
    assert {s for *_, s in expected} >= {2**63 - 1, -(2**63)}
    assert found(spark, rows, k=40) == expected
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], None, None),
        (1, None, 1, None),
        (2, [1.0, None], 1, None),
        (3, [float("nan"), 1.0], 1, None),
        (4, [float("inf"), 1.0], 1, None),
        (5, [0.5, 0.5, 0.5], 1, None),
        (6, [], 1, None),
        (None, [9.0, 9.0], 1, None),
        (7, [-0.001, 2.0], 1, None),
        (8, [0.0, 0.0], 1, None),
        (9, [2.0, 1.0], 1, None),
        (9, [1.0, 1.0], 1, None),
        (50, [0.0, 0.0], 1, None),
        (100, [1e12, 1.0], 1, None),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1, None)]) == []


def test_tree_prunes():
    draw = np.random.default_rng(1)
    points = np.floor(draw.normal(0, 100, (2000, 3)))
    tree = T.Tree(np.arange(2000), points)
    query = np.array([100.0, 50.0, 0.0])
    opened = []

    class Leaves(list):
        def __getitem__(self, node):
            opened.append(node)
            return super().__getitem__(node)

    leaves = sum(r is not None for r in tree.rows)
    tree.rows = Leaves(tree.rows)
    best = tree.search(query, tree.bounds(query[None])[0], -1, 5, T._NOTHING)
    expected = sorted(((int(s), -i) for i, s in enumerate(points @ query)), reverse=True)[:5]
    assert sorted(best, reverse=True) == expected
    assert len(opened) < leaves / 3
