"""Source mixing: exponent, budgets, whole passes and the cut."""

import math
from collections import Counter

import pytest

from outpoint.llm import mixing as M


def sized(spark, sources):
    rows = [(i, s, f"d{i} " + "w " * (n - 1)) for i, (s, n) in enumerate((s, n) for s, ns in sources.items() for n in ns)]
    return spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string")


SOURCES = {"a": [7, 3, 9, 1] * 60, "b": [5] * 50, "c": [2, 8] * 20, None: [4] * 12}
TOKENS = {s: sum(n) for s, n in SOURCES.items()}


def passes(spark, **target):
    found = M.schedule(sized(spark, SOURCES), **target).collect()
    tokens = Counter()
    for r in found:
        tokens[r.source] += r.n_tokens
    return found, {s: tokens[s] / TOKENS[s] for s in SOURCES}


def bisected(measure, target, high):
    low = 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if measure(mid) > target else (low, mid)
    return high


def weights(exponent):
    total = sum(TOKENS.values())
    power = {s: (n / total) ** exponent for s, n in TOKENS.items()}
    return {s: p / sum(power.values()) for s, p in power.items()}


def test_repeat_limit(spark):
    def most(exponent):
        gain = [w / TOKENS[s] for s, w in weights(exponent).items()]
        return max(gain) / min(gain)

    found, got = passes(spark, repeats=3.0)
    w = weights(bisected(most, 3.0, 1.0))
    least = min(w[s] / TOKENS[s] for s in w)
    for s in SOURCES:
        due = w[s] / TOKENS[s] / least
        assert got[s] <= due + 1e-6 and got[s] > due - 10 / TOKENS[s]
    assert max(got.values()) == pytest.approx(3.0, abs=0.1) and min(got.values()) == 1.0
    per_doc = Counter((r.source, r.doc_id) for r in found)
    for s in SOURCES:  # whole passes, and one more for some
        n = {c for (x, _), c in per_doc.items() if x == s}
        assert max(n) - min(n) <= 1 and min(n) >= 1
    assert all(0 <= r.turn <= 1 and 0 <= r.place < 1 for r in found)


def test_entropy_target(spark):
    def entropy(exponent):
        return -sum(w * math.log(w) for w in weights(exponent).values())

    target = (entropy(0) + entropy(1)) / 2
    _, got = passes(spark, target_entropy=target)
    w = weights(bisected(entropy, target, 16.0))
    share = {s: got[s] * TOKENS[s] for s in SOURCES}
    for s in SOURCES:
        assert share[s] / sum(share.values()) == pytest.approx(w[s], abs=0.01)


def test_budget_cuts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 20)
    budget = 900
    found, got = passes(spark, repeats=None, budget=budget)
    total = sum(TOKENS.values())
    for s in SOURCES:
        due = budget * TOKENS[s] / total
        assert due - 10 <= got[s] * TOKENS[s] <= due
    for s in SOURCES:  # the documents that come first in the pass, and no others
        taken = {r.doc_id for r in found if r.source == s}
        order = {r.doc_id: r.place for r in M.schedule(sized(spark, SOURCES), repeats=None).filter("copy = 0").collect() if r.source == s}
        assert max(order[d] for d in taken) < min(p for d, p in order.items() if d not in taken)


def test_passes_are_different_orders(spark):
    found, _ = passes(spark, repeats=None, budget=3 * sum(TOKENS.values()))
    first, second = ([d for _, d in sorted((r.place, r.doc_id) for r in found if r.copy == c)] for c in (0, 1))
    assert sorted(first) == sorted(second) and first != second


def test_odd_rows(spark, documents):
    docs = documents([(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c", None, None), (2, None, None, "s"), (3, None, None, "empty"), (4, "", None, "empty")])
    docs = docs.withColumnRenamed("lang", "key").withColumnRenamed("n_chars", "copies")
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert {str(r.doc_id) for r in mixed.collect()} == {"1", "None", "2", "3", "4"}
    assert M.schedule(documents([])).count() == 0 and M.mix(documents([])).count() == 0
    assert M.mix(documents([(1, None, None, "s"), (2, "", None, None)])).count() == 2
