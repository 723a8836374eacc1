"""Language identification: held-out accuracy, the filter, odd inputs."""

import numpy as np
import pytest

from outpoint.llm import language as L

from .conftest import rows_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train_on(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark):
    found = L.op7_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = found.merge(docs[["doc_id", "lang"]], on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert len(held) > 250 and (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_grams_of_each_text_alone():
    texts = ["Ab c", "", "!!", "é", "12x!!y", "ab c"]
    together = {}
    for first, row, hashes in L.grams(texts):
        for r, h in zip(row + first, hashes, strict=True):
            together.setdefault(int(r), []).append(int(h))
    for i, text in enumerate(texts):
        alone = [int(h) for _, _, hashes in L.grams([text]) for h in hashes]
        assert sorted(together.get(i, [])) == sorted(alone)
    assert sorted(together[0]) == sorted(together[5])
    assert 1 not in together and 2 not in together and together[3]


def test_filter_holds_all_and_corrects_chance(monkeypatch):
    monkeypatch.setattr(L, "CELLS", 1 << 12)
    draw = np.random.default_rng(1)
    names = [f"l{i:03}" for i in range(70)]
    held = {n: draw.integers(-(1 << 62), 1 << 62, 300) for n in names}
    masks, chance = L.build_filter(names, held)
    assert masks.shape == (1 << 12, 2)
    for i, name in enumerate(names):
        cells = list(L._cells(held[name].view(np.uint64)))
        assert all((masks[c, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all() for c in cells)
    other = draw.integers(-(1 << 62), 1 << 62, 20_000).view(np.uint64)
    cells = list(L._cells(other))
    hit = np.ones(len(other), bool)
    for c in cells:
        hit &= (masks[c, 0] & np.uint64(1)).astype(bool)
    assert hit.mean() == pytest.approx(chance[0], abs=0.01)


def test_odd_texts(documents, model):
    docs = documents([(1, None), (2, ""), (3, "123 !?"), (4, "the that and with"), (4, "the that and with"), (None, "x"), (5, "the and " * 50_000)])
    docs = docs.withColumnRenamed("n_chars", "score")
    found = L.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    rows = rows_of(found, "doc_id", "lang_pred")
    assert rows[:3] == [(1, "und"), (2, "und"), (3, "und")] and rows[3] == rows[4] == (4, "en") and rows[5] == (5, "en")
    assert len(rows) == 7
    assert L.identify(documents([]), model).count() == 0


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "abc", None), (3, None, "en")])
    model = L.learn(docs)
    assert model[0] == []
    assert rows_of(L.identify(docs, model), "lang_pred", "score") == [("und", 0.0)] * 2


def test_stage_keeps_clean_documents(documents, model, monkeypatch):
    monkeypatch.setattr(L, "train_on", lambda docs: model)
    docs = documents([(1, "The the and that with the of", None, "a", 3), (2, "77 88", "en"), (3, "ζζζ ξξξ ψψψ", "en")])
    kept = L.known_language(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "lang", "source", "n_chars") == [(1, "en", "a", 3)]
