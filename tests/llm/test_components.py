"""Connected components against a sequential model."""

import random

import pytest

from outpoint.llm.components import components

from .conftest import rows_of


def model(links):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted(((x, find(x)) for x in parent), key=str)


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(1, None), (None, 2), (3, 3)],
        [(2, 1), (1, 2), (2, 1), (2, 2)],
        [(i, i + 1) for i in range(60)],
        [(99, i) for i in range(80)],
        [(random.Random(i).randrange(90), random.Random(-i - 1).randrange(90)) for i in range(70)],
    ],
)
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert rows_of(components(df), "node", "component") == model(links)
