"""What a job writes on its way goes when its result stands."""

import os

import pytest
from pyspark.sql import functions as F

from outpoint import session
from outpoint.operators import merkle, utxo
from outpoint.streaming.ingest import FEED_SCHEMA, LedgerLog, ingest_batch


def folders(spark):
    place = session.work_dir(spark).removeprefix("file:")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_tables_of_a_passing_block_go(spark):
    settings = {name: spark.conf.get(name) for name in session.SETTINGS}
    with pytest.raises(RuntimeError), session.passing(spark):
        assert session.SETTINGS == {name: spark.conf.get(name) for name in session.SETTINGS}
        kept = session.materialize(spark.range(3), "kept-table", keep=True)
        with session.passing(spark):
            inner = session.materialize(spark.range(4), "inner-table")
            assert inner.count() == 4 and any(f.startswith("inner-table") for f in folders(spark))
        assert not any(f.startswith("inner-table") for f in folders(spark))
        session.materialize(spark.range(5), "outer-table")
        raise RuntimeError
    assert kept.count() == 3
    assert not any(f.startswith("outer-table") for f in folders(spark))
    assert settings == {name: spark.conf.get(name) for name in session.SETTINGS}


def test_a_batch_leaves_its_logs_only(spark, tmp_path, h):
    log = LedgerLog(spark, str(tmp_path / "log"), h("start"), 0).start()
    before = folders(spark)
    row = {c.split()[0]: None for c in FEED_SCHEMA.split(", ")}
    header = row | {"arrival": 1, "kind": "header", "hash": h(1), "prev_hash": h("start"), "merkle_root": h(2), "timestamp": 5, "numtxs": 1}
    tx = row | {"arrival": 1, "kind": "tx", "hash": h("t"), "block_hash": h(1), "blockindex": 0, "txsize": 9}
    out = row | {"arrival": 1, "kind": "out", "hash": h("t"), "block_hash": h(1), "blockindex": 0, "n": 0, "satoshis": 7, "script_hex": "51"}
    ingest_batch(log, spark.createDataFrame([header, tx, out], FEED_SCHEMA), 0)
    assert [r["hash"] for r in log.read("tx").collect()] == [h("t")] and log.utxo().count() == 1
    assert folders(spark) == before


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_outpoints_are_shuffled_once(spark, h, shuffled_joins):
    rows = [(h(i), i % 3) for i in range(200)] + [(None, 1), (h(1), None), (h(0), 0)]
    asked = spark.createDataFrame(rows, "hash string, pos bigint")
    held = spark.createDataFrame([(h(0), 0), (h(0), 0), (h(3), 1), (None, 1)], "hash string, pos bigint")
    found = utxo.outpoint_unspent(asked, held)
    answers = sorted(map(tuple, found.collect()), key=str)
    expected = [(a, p, (a, p) == (h(0), 0)) for a, p in set(rows)] + [(h(0), 0, True)]
    assert answers == sorted(expected, key=str)
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_proofs_are_not_shuffled(spark, h, shuffled_joins):
    txs = spark.createDataFrame([(h(i), 7 + i % 2, i // 2) for i in range(11)], "hash string, height bigint, blockindex bigint")
    roots = merkle.merkle_roots(txs)
    blocks = roots.filter("height = 7").select("height", F.lit(h("block")).alias("hash"), "merkle_root")
    keys = spark.createDataFrame([(h(i),) for i in range(12)] + [(None,), (h(0),)], "hash string")
    proofs = merkle.merkle_proofs(keys, txs, blocks)
    rows = {r["tx_hash"]: r for r in merkle.verify_merkle_proofs(proofs).collect()}
    assert proofs.count() == len(rows) == 13
    assert {k for k, r in rows.items() if r["found"]} == {h(i) for i in range(0, 11, 2)}
    assert all(r["verified"] if r["found"] else r["branches"] is None for r in rows.values())
    plan = proofs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    above = [line for line in plan[:at] if len(line) - len(line.lstrip(" :+-")) < depth]
    assert not any("Join" in line for line in above)
