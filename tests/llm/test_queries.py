"""Registered queries against their SQL, and the pipeline against its stages done by hand."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from outpoint.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_registered():
    names = set(driver.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    expected = duck.sql(registry.SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    theirs = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert in_order(found.select(*columns).collect()) == in_order(theirs)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, SF)
        assert at.columns == docs.columns, name
        assert at.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    texts = {}
    for r in at.collect():
        texts.setdefault(r.doc_id, []).append(hashlib.sha256((r.text or "").encode()).hexdigest())
    decoded = {}
    for r in rows:
        assert hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens
        decoded.setdefault(r.doc_id, []).append(r.decoded_sha256)
    assert decoded == texts and len(decoded) > 100
