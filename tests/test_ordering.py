import random

import pytest
from pyspark.sql import functions as F

from outpoint.operators.ordering import previous_value, row_position, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds a third of the rows, and some rows are copies."""
    rng = random.Random(7)
    data = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        data.append((group, rng.randrange(30), i, rng.randrange(100)))
    data += [("copies", 1, -1, 5)] * 300
    return spark.createDataFrame(data, "g string, a int, id int, v int").repartition(5).cache()


def key(row):
    return tuple(row)


def test_split_positions_equal_the_window(rows):
    plain = row_position(rows, ["g"], ["a", "id"], "pos", bounded=True)
    split = row_position(rows, ["g"], ["a", "id"], "pos")
    assert sorted(map(key, plain.collect())) == sorted(map(key, split.select(plain.columns).collect()))


def test_split_sums_equal_the_window(rows):
    plain = running_sum(rows, ["g"], ["a", "id"], F.col("v"), "total", bounded=True)
    split = running_sum(rows, ["g"], ["a", "id"], F.col("v"), "total")
    assert sorted(map(key, plain.collect())) == sorted(map(key, split.select(plain.columns).collect()))


def test_split_predecessors_equal_the_window(rows):
    plain = previous_value(rows, ["g"], ["a", "id"], "id", "before", bounded=True)
    split = previous_value(rows, ["g"], ["a", "id"], "id", "before")
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, plain.collect()), key=order) == sorted(
        map(key, split.select(plain.columns).collect()), key=order
    )


def test_one_group_of_everything(spark):
    df = spark.range(1000).withColumn("one", F.lit(1))
    out = row_position(df, ["one"], ["id"], "pos")
    assert out.filter("pos <> id").count() == 0 and out.count() == 1000
