"""Line dedup against all pairs of lines."""

import random
from collections import defaultdict

import numpy as np

from outpoint.llm import line_dedup as D

from .conftest import rows_of

BLANK = " \t\n\x0b\x0c\r"


def shingles(line):
    low = line.encode().lower().decode()
    return {low[i : i + 6] for i in range(len(low) - 5)} or {low}


def brute(rows):
    lines = [(i, p, x.strip(BLANK)) for i, t in rows if i is not None for p, x in enumerate((t or "").split("\n")) if x.strip(BLANK)]
    group = list(range(len(lines)))
    sets = [shingles(x) for *_, x in lines]

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    first: dict = {}
    for n, (i, p, _) in enumerate(lines):
        first[find(n)] = min(first.get(find(n), (i, p)), (i, p))
    gone = defaultdict(set)
    for n, (i, p, _) in enumerate(lines):
        if first[find(n)] != (i, p):
            gone[i].add(p)
    return sorted(((i, t if t is None or not gone[i] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])) for i, t in rows), key=str)


def test_equals_all_pairs(documents):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    base = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 3, 12, 30, 60]))) for _ in range(40)]

    def line():
        out = draw.choice(base).split(" ")
        if draw.random() < 0.4 and len(out) > 10:
            out[draw.randrange(len(out))] = draw.choice(words)
        return draw.choice(["", "  ", "\t"]) + " ".join(out).replace("a", draw.choice("aA"), 1) + draw.choice(["", " ", "\r"])

    rows = [(i, "\n".join(line() if draw.random() < 0.9 else "" for _ in range(draw.randint(1, 12)))) for i in range(60)]
    assert rows_of(D.dedup_lines(documents(rows).repartition(4)), "doc_id", "text") == brute(rows)


def test_odd_rows(documents):
    rows = [
        (9, "same line here\nonly here é"),
        (4, "SAME line here \n\n\nsame line here"),
        (4, "SAME line here \n\n\nsame line here"),
        (None, "same line here"),
        (5, None),
        (6, ""),
        (7, "\n \n"),
        (8, "ab\nab\nAB \nabc"),
        (3, "x" * 300_000 + "\n" + "y" * 10),
        (2, "y" * 10 + "\n" + "x" * 299_999),
    ]
    docs = documents(rows).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "gone")
    found = D.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "gone", "n_chars", "n_lines", "n_dropped"]
    # Rows 4 are one document: the first line stays in both.
    expected = [(9, "only here é"), (4, "SAME line here \n\n"), (4, "SAME line here \n\n"), *rows[3:7], (8, "ab\nabc"), (3, ""), rows[9]]
    assert rows_of(found, "doc_id", "text") == sorted(expected, key=str)
    counts = {r.doc_id: (r.n_lines, r.n_dropped) for r in found.collect()}
    assert counts[9] == (2, 1) and counts[8] == (4, 2) and counts[7] == (0, 0) and counts[3] == (2, 2)
    assert D.dedup_lines(documents([])).count() == 0


def test_stage_drops_what_is_empty_now(documents):
    docs = documents([(1, "a line of text"), (2, "a line of text"), (3, ""), (4, None), (5, "a line of text\nanother thing")])
    kept = D.without_repeats(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") == [(1, "a line of text"), (3, ""), (4, None), (5, "another thing")]


def test_bands_find_close_lines():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    one, two = [], []
    for _ in range(800):
        line = [draw.choice(words) for _ in range(draw.choice([8, 15, 30, 40]))]
        other = list(line)
        other[draw.randrange(len(line))] = draw.choice(words)
        one.append(" ".join(line).encode())
        two.append(" ".join(other).encode())
    close = np.array([len(a & b) / len(a | b) >= 0.8 for a, b in zip(map(shingles, map(bytes.decode, one)), map(shingles, map(bytes.decode, two)), strict=True)])
    keys = [{} for _ in range(2)]
    for held, lines in zip(keys, (one, two), strict=True):
        for line, key in zip(*D.band_keys(lines), strict=True):
            held.setdefault(int(line), set()).add(int(key))
    met = np.array([bool(keys[0][i] & keys[1][i]) for i in range(len(one))])
    assert close.sum() > 200 and met[close].mean() > 0.98


def test_texts_are_not_sorted_and_reach_python_once(documents):
    docs = documents([(1, "a line of text"), (2, "a line of text\nanother thing")])
    plan = D.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("ShuffledHashJoin")]
    assert "Sort" not in last and "row" in last
    assert "text" not in plan[plan.index("AS row") - 200 : plan.index("AS row")].rsplit("struct(", 1)[1]


def test_white_space_around_lines():
    texts = [f"{' ' * n}x y{' ' * m}\n{' ' * n}\n\t\r" for n in (0, 1, 15, 16, 17, 400) for m in (0, 16, 17, 90)] + ["", " " * 50, "\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows, place, starts, ends = D.line_spans(data, at)
    assert rows.tolist() == list(range(24)) and not place.any()
    assert {data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)} == {b"x y"}
