"""What lookups, admission, fees and the rebuild move: keys once, hashes as bytes, elements of transactions not at all."""

import pyarrow.parquet as pq

from outpoint.functions import codec, hashing
from outpoint.operators import lookups, utxo
from outpoint.sources.keyed import KeyedTable
from outpoint.streaming import ingest
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, shapes):
    """(hash, tx) of transactions named by two digits with (inputs, outputs) each."""
    txs = [(f"0{i}", 1, 0, n, m) for i, (n, m) in enumerate(shapes)]
    ins = [(f"0{i}", v, "ab" * 32, v, "", 7) for i, (n, _) in enumerate(shapes) for v in range(n)]
    outs = [(f"0{i}", p, 5 + p, "51" * (1 + p)) for i, (_, m) in enumerate(shapes) for p in range(m)]
    raw = codec.encode_tx_table(
        spark.createDataFrame(txs, "hash string, version int, locktime long, nin long, nout long"),
        spark.createDataFrame(ins, "hash string, vin long, prev_hash string, prev_index long, script_sig_hex string, sequence long"),
        spark.createDataFrame(outs, "hash string, pos long, satoshis long, script_hex string"),
    )
    return codec.whole_transactions(raw).select("hash", hashing.to_hex(F.col("raw")).alias("tx"))


def test_elements_of_captured_transactions_are_not_shuffled(spark):
    held = texts(spark, [(2, 2), (1, 1), (0, 0)])
    held = held.unionByName(held).unionByName(spark.createDataFrame([("bad", "00ff"), (None, "00")], "hash string, tx string"))
    left = spark.createDataFrame([("00", 1), ("01", 0), ("01", 0), ("no", 0), (None, 0)], "hash string, pos long")
    keys = spark.createDataFrame([("00",), ("00",), ("01",), ("02",), ("bad",), ("no",), (None,), (None,)], "hash string")
    found = lookups.collection_entries(keys, held, left)
    text = plan(found)
    assert "Generate" in text and "Exchange" not in text[: text.index("Generate")]
    assert found.columns == ["hash", "version", "locktime", "side", "n", "script_hex", "prev_hash", "prev_index", "sequence", "satoshis", "spent", "failed"]
    rows = sorted(map(str, (tuple(r) for r in found.collect())))
    spent = [("00", 1, 0, "in", n, "", "ab" * 32, n, 7, None, None, None) for n in (0, 1)]
    made = [("00", 1, 0, "out", n, "51" * (1 + n), None, None, None, 5 + n, n == 0, None) for n in (0, 1)]
    other = [("01", 1, 0, "in", 0, "", "ab" * 32, 0, 7, None, None, None)]
    # An outpoint that is twice in the unspent set gives two rows.
    other += [("01", 1, 0, "out", 0, "51", None, None, None, 5, False, None)] * 2
    none = [("02", 1, 0, *[None] * 9)] + [(k, *[None] * 10, f"Unknown txid {k}") for k in ("bad", "no")] + [(None,) * 12]
    assert rows == sorted(map(str, spent + made + other + none))


def test_files_near_the_keys_are_not_joined_with_them(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "hash string, height bigint", ["hash"])
    table.upsert(spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").alias("height")))
    keys = table.read().filter("height < 3").select("hash")
    near = table.near(keys, "hash")
    assert "Join" not in plan(near)
    assert near.join(keys, "hash", "left_semi").count() == table.find(keys, "hash", unique=True).count() == 3
    assert lookups.tx_exists(keys, near, near.limit(0), near.limit(0)).filter("known").count() == 3


def test_keys_are_shuffled_once(spark):
    keys = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    keys = keys.unionByName(spark.createDataFrame([(None,), (None,)], "hash string"))
    held = keys.limit(20).withColumn("tx", F.lit("00")).unionByName(spark.createDataFrame([(None, "11")], "hash string, tx string"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookups.hex_from_collection(keys, held)
        rows = found.collect()
        assert "ReusedExchange" in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) == 51 and sum(r["tx"] is not None for r in rows) == 20
    assert [(r["tx"], r["failed"]) for r in rows if r["hash"] is None] == [(None, None)]


def test_submitted_transactions_are_written_as_bytes(spark):
    sent = texts(spark, [(1, 1)]).withColumn("hash", F.lit("ab")).withColumn("i", F.lit("b"))
    sent = sent.unionByName(sent.withColumn("i", F.lit("abc")))
    known = spark.createDataFrame([], "hash string")
    found = lookups.admit_broadcasts(sent, known, 300, "i")
    written = {f.name: str(f.type) for path in found.inputFiles() for f in pq.read_schema(path.removeprefix("file://")).remove_metadata()}
    assert written["txid"] == written["hash"] == "binary"
    rows = {r["i"]: (r["hash"], r["accepted"]) for r in found.collect()}
    # The turn is that of the texts, not of their bytes.
    assert rows == {"abc": ("ab", True), "b": ("ab", False)}


def test_spenders_are_reduced_once_for_all_and_again_for_coinbases_only(spark):
    ins = [("c", "x", 0, 1, 0), ("d", "x", 0, 2, 1), ("e", "y", 0, 3, 1), ("f", "y", 0, 4, 0)]
    outs = [("x", 0, 9, "51", 0), ("y", 0, 8, "51", 0)]
    inputs = spark.createDataFrame(ins, "hash string, prev_hash string, prev_index long, seq long, blockindex long")
    outputs = spark.createDataFrame(outs, "hash string, pos long, satoshis long, script_hex string, seq long")
    found = utxo.fees(inputs.select("hash"), inputs, outputs)
    assert "spent#" in plan(found)
    first = {r["hash"]: r["fee"] for r in found.collect()}
    assert first == {"c": 9, "d": 9, "e": 8, "f": 0}


def test_a_rebuild_looks_for_holders_by_bytes(spark, monkeypatch):
    from outpoint.plans.view import MONITORS

    kinds, assign = [], ingest.monitors.assign

    def seen(txs, inputs, matches, rules):
        kinds.extend(df.schema["hash"].dataType.simpleString() for df in (txs, inputs, matches))
        return assign(txs, inputs, matches, rules)

    monkeypatch.setattr(ingest.monitors, "assign", seen)
    note = "006a0a436f437631" + "00" * 5
    blocks = spark.createDataFrame([("b1", "b0", 1.0)], "hash string, prev_hash string, arrival double")
    txs = spark.createDataFrame([("b1", "aa", 0, 9), ("b1", "bb", 1, 9), ("b1", "xyz", 2, 9)], "block_hash string, hash string, blockindex long, txsize long")
    ins = spark.createDataFrame([("b1", "bb", 1, "aa", 0)], "block_hash string, hash string, blockindex long, prev_hash string, prev_index long")
    outs = spark.createDataFrame([("b1", "aa", 0, 5, note), ("b1", "xyz", 0, 5, note)], "block_hash string, hash string, pos long, satoshis long, script_hex string")
    found = ingest.rebuild(blocks, txs, ins, outs, "b0", 0, MONITORS)["collection"]
    assert sorted(map(tuple, found.collect())) == [("aa", "CoCv1"), ("bb", "CoCv1"), ("xyz", "CoCv1")]
    assert kinds == ["binary"] * 3
