"""Every registered query against its SQL, on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from outpoint.plans import oracle, registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, oracle.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    kinds = {f.name: TYPES[f.dataType.simpleString()] for f in found.schema}
    assert kinds == dict(zip(expected.columns, map(str, expected.types)))
    theirs = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    ours = found.select(*[f"`{c}`" for c in columns]).collect()
    assert len(ours) > 0
    assert in_order(ours) == in_order(theirs)


def test_flagship(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) > 0 and rows[0]["confirmed"] >= rows[-1]["confirmed"]
