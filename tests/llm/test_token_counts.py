"""Token counts against the library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from outpoint.llm import token_counts as C


@pytest.fixture(scope="module")
def whole():
    known = Tokenizer.from_file(C.VOCABULARY)
    return lambda text: len(known.encode(text or "", add_special_tokens=False).ids)


def check(documents, whole, texts, **options):
    rows = list(enumerate(texts))
    found = sorted(C.count_tokens(documents(rows), **options).collect(), key=lambda r: r.doc_id)
    expected = [(i, len((t or "").encode()), whole(t), whole(t) > 2048) for i, t in rows]
    assert [tuple(r) for r in found] == expected


ODD = [
    None,
    "",
    "   \n\t ",
    "It's what WE'LL see, don't they'RE 1234 ½",
    "a<|endoftext|>b <|startoftext|> <|endoftext|>\n",
    "é ́x   y\x1cz\x85w İI ΣΣ ς",
    "日本語 \U0001f600\U0001f600 ﬁ Å",
]


def test_odd_texts(documents, whole):
    check(documents, whole, ODD)


@pytest.mark.parametrize("overlap", [1, 4, 16])
def test_chunks_splice_to_the_whole(documents, whole, overlap):
    random.seed(overlap)
    pieces = ["it's", "don't", "<|endoftext|>", "́a", "1234", "日本", "antidisestablishment" * 3, "!!!", "\n\n", "x", "é"]
    texts = [" ".join(random.choice(pieces) for _ in range(random.randint(1, 150))) for _ in range(12)]
    texts += ["nospace" * 60, "a" * 200 + " " + "b" * 200, " " * 300, "x" + " " * 100 + "y" * 90]
    check(documents, whole, texts + ODD, chunk=40, overlap=overlap)


def test_long_text_without_white_space(documents, whole):
    check(documents, whole, ["ab,cd" * 20_000, "word " * 30_000])


def test_repeated_and_missing_ids_and_extra_columns(documents, whole):
    docs = documents([(1, "a b"), (1, "a b"), (None, "c"), (2, "x " * 60)]).withColumnRenamed("n_chars", "n_tokens").withColumnRenamed("lang", "key")
    found = C.count_tokens(docs, chunk=50, overlap=8).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == [("1", 2), ("1", 2), ("2", 60), ("None", 1)]
    assert C.count_tokens(documents([])).count() == 0
