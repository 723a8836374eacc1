"""Fill-in-middle: the rank index, cuts against brute force, odd rows."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outpoint.llm import fill_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def arranged(doc_id, text):
    """n, form, sizes, output and the text rebuilt, done plainly."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 or doc_id is None:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def offsets_of(texts):
    column = pa.array(texts, pa.string())
    data, at = M.tb.string_parts(column)
    return M.token_ends(data, at)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t 日", max_size=30) | st.none(), min_size=1, max_size=6), st.integers(0, 3))
def test_index_gives_every_offset(texts, bound):
    offsets, starts = offsets_of(texts)
    index = M.RankIndex(offsets, starts, bound)
    assert np.abs(index.residuals).max(initial=0) <= bound
    for i, text in enumerate(texts):
        expected = [0, *np.cumsum([len(t.encode()) for t in TOKEN.findall(text or "")]).tolist()]
        ranks = np.arange(len(expected))
        assert index.offset(np.full(len(ranks), i), ranks).tolist() == expected


def test_uneven_texts_need_more_segments_and_stay_exact():
    text = "a " * 3000 + "x" * 50_000 + " " + "longer words here " * 2000 + "\n" * 900
    offsets, starts = offsets_of([text, "", None, "one"])
    index = M.RankIndex(offsets, starts)
    assert 4 < len(index.lo) < 200
    ranks = np.arange(starts[1])
    assert (index.offset(np.zeros(len(ranks), np.int64), ranks) == offsets[: starts[1]]).all()
    assert index.offset(np.array([1, 2, 3, 3]), np.array([0, 0, 0, 1])).tolist() == [0, 0, 0, 3]


def test_stored_index_is_read_by_expressions(spark, documents):
    texts = ["a é " * 400 + "word" * 200 + " b" * 300, "", None, " \n", "one"]
    index = M.rank_index(documents(list(enumerate(texts))), bound=3)
    at = index.select("id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("r"), "segments", "residuals", "n")
    got = {(r.id, r.r): r.o for r in at.select("id", "r", M.offset_at(F.col("r")).alias("o")).collect()}
    for i, text in enumerate(texts):
        expected = [0, *np.cumsum([len(t.encode()) for t in TOKEN.findall(text or "")]).tolist()]
        assert [got[i, r] for r in range(len(expected))] == expected
    assert index.select(M.offset_at(F.col("n") + 1)).distinct().collect()[0][0] is None


def test_against_brute_force(spark, documents):
    texts = ["", None, " ", "word", "  two words ", "a<P>b c", "é è ê ë", "x y z w", "a\tb\nc\rd\x0be", "<P <S <M", "<", "tail <"]
    rows = [(i, texts[i % len(texts)]) for i in range(240)] + [(None, "no key here"), (7, "same id"), (7, "same id")]
    rows.append((500, "long " * 200_000))
    found = M.fill_in_middle(documents(rows)).withColumn("back", M.restored()).collect()
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found)
    assert got == sorted((str(i), *arranged(i, t)) for i, t in rows)
    assert all(r.back == (r.text or "") for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_columns_of_the_result_replace_those_of_the_input(spark, documents):
    docs = documents([(1, "a b")]).withColumn("form", F.lit(5)).withColumn("_h1", F.lit("kept"))
    out = M.fill_in_middle(docs.withColumn("n", F.lit("x")))
    assert out.columns[-5:] == ["n", "form", "output", "prefix_chars", "middle_chars"] and out.columns.count("form") == 1
    assert out.first()["_h1"] == "kept"
    assert M.fill_in_middle(documents([])).count() == 0


@pytest.mark.parametrize("block", [16, 64])
def test_blocks_do_not_change_results(spark, monkeypatch, block):
    texts = [f"text {i} é " * (i % 7) for i in range(50)]
    drawn = [np.arange(50) * k + 3 for k in (7, 11, 13, 17)]
    whole = list(M._arranged(pa.array(texts), drawn, np.ones(50, bool), 127))
    monkeypatch.setattr(M.tb, "runs", lambda at: [(i, min(50, i + block)) for i in range(0, 50, block)])
    parts = list(M._arranged(pa.array(texts), drawn, np.ones(50, bool), 1))
    assert [x for p in parts for x in p["output"]] == whole[0]["output"]
