"""The set join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from outpoint.llm import jaccard_join as J
from outpoint.llm import lists

from .conftest import rows_of

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    near: dict = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 4 * len(x & y) >= 3 * len(x | y):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    out = []
    for a, x in sets:
        seen, todo = {a}, [a]
        while todo:
            for n in near.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out.append((a, len(x), None if a is None else min(seen)))
    return sorted(out, key=str)


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 5, 6, 8, 9, 12, 20, 60, 200]))]
        for _ in range(draw.randint(1, 14)):
            words = list(base)
            for _ in range(draw.randint(0, 1 + len(words) // 40)):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = [draw.choice(vocabulary)] * draw.randint(0, 1)
            rows.append((len(rows), draw.choice([" ", "  ", "\n"]).join(words).upper() if draw.random() < 0.2 else " ".join(words)))
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows += [(len(rows) + i, " ".join(draw.choice(vocabulary) for _ in range(70)) + " " + passage) for i in range(15)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("boundary", [None, 0, 8, 64])
def test_every_boundary(spark, documents, boundary):
    rows = corpus()
    assert rows_of(J.jaccard_join(documents(rows).repartition(3), boundary), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_long_lists_and_many_buckets(spark, documents, monkeypatch):
    monkeypatch.setattr(lists, "SHORT_LIST", 2)
    monkeypatch.setattr(lists, "BUCKET_KEYS", 200)
    rows = corpus(7)
    assert rows_of(J.jaccard_join(documents(rows).repartition(5)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_second_pass_finds_what_the_first_leaves_apart(spark):
    # One long list; only pairs away from the first id and from neighbours are linked.
    import numpy as np

    ids = np.arange(20, dtype=np.int64)
    batch = lists.pack(ids, np.full(20, 10), np.full(20, 7 << 40, np.uint64), 1, [(100, 101)])
    packed = spark.createDataFrame(batch.to_pandas(), lists.PACKED)
    # Neighbours on the line 3 - 9 - 17 share enough, its ends do not.
    words = {i: [f"{i}x{k}" for k in range(60)] for i in range(20)}
    words |= {i: [f"w{k}" for k in range(at, at + 60)] for i, at in ((3, 0), (9, 6), (17, 12))}
    bodies = [(i, lists.packed_text(" ".join(w).encode())) for i, w in words.items()]
    texts = spark.createDataFrame(bodies, "id long, body binary")
    found = rows_of(lists.list_components(packed, lambda wanted: texts, J._shingles_of, 3, 4), "node", "component")
    assert found == sorted([(3, 3), (9, 3), (17, 3), (100, 100), (101, 100)], key=str)


def test_odd_rows(spark, documents):
    text = "one two three four five six seven eight"
    rows = [(5, text), (3, text.upper()), (3, "else"), (None, text), (7, None), (8, ""), (9, " \n"), (10, "a b"), (11, "A  b"), (12, "b a"), (13, "else")]
    rows += [(20, "z " * 40_000), (21, "z " * 40_001), (22, "é x y z"), (23, "É x y z")]
    docs = documents(rows).withColumnRenamed("lang", "n_shingles").withColumnRenamed("source", "component_id")
    assert rows_of(J.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == brute(rows)
    assert J.jaccard_join(documents([])).count() == 0


def test_keep_one(documents):
    text = "one two three four five six seven eight"
    docs = documents([(5, text, "en", "a", 1), (3, text, "en", "b", 2), (None, text), (7, None), (8, "")])
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "source") == [(3, "b"), (7, None), (8, None), (None, None)]


def test_sketches_rule_out_no_link():
    import numpy as np

    draw = np.random.default_rng(8)
    ruled_out = 0
    for _ in range(400):
        shared = draw.integers(0, 1 << 63, draw.integers(1, 900), dtype=np.uint64)
        one, two = (np.concatenate([shared, draw.integers(0, 1 << 63, draw.integers(0, 1 + len(shared) // 2), dtype=np.uint64)]) for _ in range(2))
        x, y = (np.frombuffer(lists.sketch(s), np.uint64) for s in (one, two))
        words = min(len(x), len(y))
        possible = lists.may_link(lists._folded(x[None], words), lists._folded(y[None], words), len(one), len(two), 3, 4)[0]
        linked = 4 * len(shared) >= 3 * (len(one) + len(two) - len(shared))
        assert possible or not linked
        ruled_out += not possible
    assert ruled_out > 150


def test_only_texts_of_possible_pairs_move(documents, monkeypatch):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    passage = [draw.choice(words) for _ in range(40)]
    rows = [(i, " ".join(passage[:6] + [draw.choice(words) for _ in range(200)])) for i in range(12)]
    rows += [(20 + i, " ".join([*rows[0][1].split(" ")[:180], f"tail{i}"])) for i in range(2)]
    moved, check = [], lists.similar_pairs

    def seen(pairs, texts, *more):
        moved.append(({r.id for r in texts.collect()}, {x for r in pairs.collect() for x in r}))
        return check(pairs, texts, *more)

    monkeypatch.setattr(lists, "similar_pairs", seen)
    found = dict(rows_of(J.jaccard_join(documents(rows), boundary=0), "doc_id", "component_id"))
    assert found == {i: 0 if i >= 20 else i for i, _ in rows}
    assert moved and all(texts == pairs and len(texts) < 12 for texts, pairs in moved)


def test_pairs_apart_over_groups_and_batches(monkeypatch):
    monkeypatch.setattr(lists, "GROUPS_ROWS", 8)
    monkeypatch.setattr(lists, "PAIRS_AT_ONCE", 16)
    draw = np.random.Generator(np.random.PCG64(5))
    rows = []
    for head in range(40):
        base = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
        for _ in range(int(draw.integers(1, 14))):
            own = draw.integers(0, 1 << 63, int(draw.integers(0, 120)), dtype=np.uint64)
            elements = np.unique(np.concatenate([base[: int(draw.integers(20, 200))], own]))
            rows.append((head, int(draw.integers(0, 40)), int(draw.integers(0, 3)), len(elements), [int(x) for x in draw.integers(0, 4, 2)], lists.sketch(elements)))
    rows.sort(key=lambda r: (r[0], r[3], r[1]))
    names = ["head", "a", "part", "n", "lists", "sketch"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    found = sorted(p for b in lists._apart(3, 4)(table.to_batches(max_chunksize=5)) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True))
    expected = []
    for k, x in enumerate(rows):
        for y in rows[k + 1 :]:
            if x[0] != y[0] or x[1] == y[1] or x[2] == y[2] or set(x[4]).isdisjoint(y[4]) or 4 * x[3] < 3 * y[3]:
                continue
            p, q = (np.frombuffer(r[5], np.uint64) for r in (x, y))
            if lists.may_link(lists._folded(p[None], len(p)), lists._folded(q[None], len(p)), x[3], y[3], 3, 4)[0]:
                expected.append((min(x[1], y[1]), max(x[1], y[1])))
    assert found == sorted(expected) and len(found) > 10
