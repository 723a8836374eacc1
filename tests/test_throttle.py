import random

import pytest
from pyspark.sql import functions as F

from outpoint.streaming import throttle


def sequential(requests, limit, window):
    state, out = {}, {}
    for client, t, i in sorted(requests, key=lambda r: (r[1], r[2])):
        start, count = state.get(client, (t, 0))
        if t - start >= window:
            start, count = t, 0
        out[i] = limit == 0 or count < limit
        state[client] = (start, count + out[i])
    return out


def requests(seed, n=1500, span=40_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # One client sends a third of the requests, some at one moment.
        client = "hot" if i % 3 == 0 else f"c{rng.randrange(60)}"
        t = rng.randrange(span)
        rows.append((client, t - t % 50 if client == "hot" else t, i))
    return rows


@pytest.mark.parametrize("limit,window", [(2, 700), (1, 60), (3, 5000), (2, 100_000), (0, 10)])
def test_batch_equals_one_by_one(spark, limit, window):
    rows = requests(limit * 7 + window)
    df = spark.createDataFrame(rows, "client string, t bigint, id bigint").repartition(7)
    found = {r["id"]: r["admitted"] for r in throttle.throttle(df, limit, window).collect()}
    assert found == sequential(rows, limit, window)


def test_golden_limits(spark):
    rows = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 2, 4), ("a", 60_000_000, 5), ("a", 59_999_999, 6)]
    df = spark.createDataFrame(rows, "client string, t bigint, id bigint")
    found = {r["id"]: r["admitted"] for r in throttle.throttle(df, 2).collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_stream_keeps_state(spark, tmp_path):
    rows = sorted(requests(5, 600), key=lambda r: r[1])
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "client string, t bigint, id bigint"
    for part in (rows[:200], rows[200:350], rows[350:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(landing)
        judged = throttle.throttle_stream(spark.readStream.schema(schema).parquet(landing), 2, 700)
        query = (
            judged.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    found = {r["id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert found == sequential(rows, 2, 700)


def test_client_key(spark):
    rows = [("1.1.1.1, 2.2.2.2", "p"), (" 3.3.3.3 ", "p"), ("", "p"), (None, "p"), (None, None)]
    df = spark.createDataFrame(rows, "f string, p string")
    found = [r[0] for r in df.select(throttle.client_key(F.col("f"), F.col("p"))).collect()]
    assert found == ["1.1.1.1", "3.3.3.3", "p", "p", "unknown"]
