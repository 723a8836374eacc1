"""Near vectors against all pairs."""

import numpy as np
import pytest

from outpoint.llm import near_vectors as N

VECTORS = "vec_id long, embedding array<float>, label int, uid string"


def brute(rows, threshold=0.93):
    unit = []
    for vec_id, v, label, *_ in rows:
        good = vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float32).astype(float) if good else None
        unit.append(a / np.linalg.norm(a) if good else None)
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
    nodes: dict = {}
    for i, near in links.items():
        for j in near:
            nodes.setdefault(rows[i][0], set()).add(rows[j][0])
    out = []
    for i, row in enumerate(rows):
        seen, todo = {row[0]}, [row[0]]
        while todo:
            for n in nodes.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        low = None if row[0] is None else min(seen)
        out.append((row[0], len(links[i]), low, None if row[0] is None else low == row[0]))
    return sorted(out, key=str)


def found(spark, rows):
    df = N.near_vectors(spark.createDataFrame(rows, VECTORS))
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(n, copies, dims=16, seed=3):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        centre = draw.normal(0, 1, dims)
        for _ in range(copies):
            rows.append((len(rows), [float(x) for x in centre + draw.normal(0, 0.1, dims)], i % 2, None))
    return rows


@pytest.mark.parametrize("blocks", [2048, 20])
def test_clusters_over_many_leaves(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "LEAF_ROWS", 32)
    monkeypatch.setattr(N, "BLOCK_ROWS", blocks)
    rows = clustered(60, 6) + [(5000 + i, [1.0] * 16, 0, None) for i in range(70)]
    expected, got = brute(rows), found(spark, rows)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in expected)
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))
    assert got == expected


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1, "x"),
        (2, [2.0, 0.0], 1, "x"),
        (3, [1.0, 0.0], 2, None),
        (4, [1.0, 0.0], None, None),
        (5, None, 1, None),
        (6, [], 1, None),
        (7, [0.0, 0.0], 1, None),
        (8, [1.0, None], 1, None),
        (9, [float("nan"), 0.0], 1, None),
        (10, [float("inf"), 0.0], 1, None),
        (11, [1.0, 0.0, 0.0], 1, None),
        (None, [1.0, 0.0], 1, None),
        (2, [0.0, 1.0], 1, None),
        (0, [0.0, 3.0], 1, None),
        (12, [1e30, 1e-30], 3, None),
        (13, [1e-30, 1e-38], 3, None),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(4, None, None, None)]) == [(4, 0, 4, True)]
