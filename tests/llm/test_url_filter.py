"""URL rules and the weighted vocabulary."""

import pytest

from outpoint.llm import url_filter as U

from .conftest import rows_of


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("HTTP://A.Net/X?y#z", "a.net", "/X"),
        ("http://a.net", "a.net", ""),
        ("http://a.net?x://b", "a.net", ""),
        ("a.net/x", "", ""),
        (None, "", ""),
        ("", "", ""),
        ("x://É.net:80/#", "É.net:80", "/"),
        ("://h/p", "h", "/p"),
    ],
)
def test_split(url, host, path):
    assert U.split_url(url) == (host, path)


@pytest.mark.parametrize(
    ("url", "weight"),
    [
        ("http://x/casino", 6),
        ("http://x/casinos", 0),
        ("http://x/CASINO-casino", 6),
        ("http://x/poker/poker-pills", 4),
        ("http://x/poker/loan-pills", 6),
        ("adult", 2),
        ("1adult", 0),
    ],
)
def test_weights(url, weight):
    assert U.weight_of(url, U.automaton(U.VOCABULARY)) == weight


def test_rules_and_verdicts(spark):
    urls = [
        "http://example.net/en/1",
        "http://a.example.net/de/1",
        "http://badexample.net/en/1",
        "http://net",
        "http://x.org/fr/porn",
        "http://x.org/en/porn",
        "http://www.example.com/de/",
        "http://example.com/en/",
        None,
        "casino",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], None)], "page_id long, url string, verdict string")
    found = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages).collect()}
    assert found == {
        0: ("example.net/en/", "allow"),
        1: ("net/", "block"),
        2: ("net/", "block"),
        3: (None, "allow"),
        4: ("org/fr/", "allow"),
        5: (None, "block"),
        6: ("example.com/de/", "block"),
        7: (None, "allow"),
        8: (None, "allow"),
        9: (None, "block"),
        None: ("example.net/en/", "allow"),
    }


def test_empty_table_vocabulary_and_long_url(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty).count() == 0
    long = spark.createDataFrame([(1, "http://x/" + "a" * 300_000 + "/casino"), (1, "http://x/")], "page_id long, url string")
    assert rows_of(U.judge(long), "page_id", "verdict") == [(1, "allow"), (1, "block")]
    assert rows_of(U.judge(long, vocabulary=()), "verdict") == [("allow",), ("allow",)]


def test_a_large_vocabulary_and_another_limit(spark):
    """Strict terms block alone at any limit, and a hundred thousand terms are looked up once per batch."""
    vocabulary = [(f"t{i}x", None if i % 1000 == 0 else 3) for i in range(100_000)]
    urls = [(i, f"http://h.test/t{i}x-t{i}x/t{i + 1}x") for i in range(3000)]
    out = U.judge(spark.createDataFrame(urls, "page_id long, url string"), rules=(), vocabulary=vocabulary, limit=50)
    blocked = {r["page_id"] for r in out.filter("verdict = 'block'").collect()}
    assert blocked == {i for i in range(3000) if i % 1000 in (0, 999)}
    assert {r["weight"] for r in out.filter("verdict = 'allow'").collect()} == {6}
