"""What the view and the encoder shuffle: keys that are short, and no table for the sake of a few large transactions."""

import datetime as dt
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from outpoint import session
from outpoint.functions import codec, hashing
from outpoint.operators import lookups, monitors
from outpoint.plans.view import MONITORS, Ledger, tx_hash
from outpoint.sources.keyed import KeyedTable
from outpoint.streaming import ingest

DAY = dt.datetime(1995, 3, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def ledger(spark, tmp_path):
    orders = [(i, i % 3, "P" if i % 4 == 3 else "F", 1.0, DAY + dt.timedelta(days=i // 4), "1-URGENT") for i in range(24)]
    lines = [(i, i, i % 5, n, 1.0, 10.5 + n, 0.0, 0.0, "ARN"[n % 3], "OF"[i % 2], DAY) for i in range(24) for n in range(i % 6)]
    # A repeated order, and one without a key.
    orders += [orders[5], (None, 1, "F", 1.0, DAY, "2-HIGH")]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    return Ledger(spark, str(tmp_path))


def test_hashes_of_the_view_are_those_of_the_order_keys(ledger):
    for table in (ledger.txs, ledger.outputs, ledger.inputs, ledger.tx_sizes, ledger.matches, ledger.assigned):
        assert table.filter(~F.col("hash").eqNullSafe(tx_hash(F.col("okey")))).count() == 0
        assert table.count() > 0
    chained = ledger.inputs.filter("prev_okey IS NOT NULL")
    assert chained.count() > 0 and chained.filter(F.col("prev_hash") != tx_hash(F.col("prev_okey"))).count() == 0
    held = monitors.assign(ledger.txs, ledger.inputs, ledger.matches, MONITORS)
    assert sorted(held.collect()) == sorted(ledger.assigned.select("hash", "priority").collect())
    assert ledger.utxo.join(ledger.outputs, ["hash", "pos"], "left_anti").count() == 0
    assert ledger.txs.filter("hash IS NULL").count() == 1 and ledger.txs.groupBy("hash").count().filter("count = 2").count() == 1


@pytest.mark.parametrize("name", ["outputs", "inputs", "tx_sizes", "mempool", "utxo"])
def test_tables_of_the_view_are_joined_without_hashes(ledger, name):
    text = plan(getattr(Ledger, f"_build_{name}")(ledger))
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert read and not any(column.split("#")[0] in ("hash", "prev_hash") for columns in read for column in columns.split(","))


def wire(spark, shapes):
    """Tables of transactions named t0, t1, ... with (inputs, outputs) each."""
    txs = spark.createDataFrame([(f"t{i}", 1, 0, n, m) for i, (n, m) in enumerate(shapes)], "hash string, version int, locktime long, nin long, nout long")
    prev = "ab" * 32
    ins = [(f"t{i}", v, prev, v, "", 7) for i, (n, _) in enumerate(shapes) for v in range(n)]
    outs = [(f"t{i}", p, 5 + p, "51" * (1 + p % 3)) for i, (_, m) in enumerate(shapes) for p in range(m)]
    return (
        txs,
        spark.createDataFrame(ins, "hash string, vin long, prev_hash string, prev_index long, script_sig_hex string, sequence long"),
        spark.createDataFrame(outs, "hash string, pos long, satoshis long, script_hex string"),
    )


def test_outputs_of_small_transactions_are_not_joined(spark, monkeypatch):
    tables = wire(spark, [(1, 2), (2, 1), (3, 40), (0, 0)])
    text = plan(codec.encode_tx_table(*tables))
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    whole = {r["hash"]: bytes(r["raw"]) for r in codec.encode_tx_table(*tables).collect()}
    # With chunks of a few parts the transactions go the way of the large ones.
    monkeypatch.setattr(codec, "PARTS_PER_CHUNK", 4)
    chunks = codec.encode_tx_table(*tables).orderBy("hash", "chunk").collect()
    assert max(r["chunk"] for r in chunks) == 11
    joined = {h: b"".join(bytes(r["raw"]) for r in chunks if r["hash"] == h) for h in whole}
    assert joined == whole
    assert [len(codec.read_tx(whole[f"t{i}"], 0)[0][2]) for i in range(4)] == [2, 1, 40, 0]


def test_repeated_transactions_are_encoded_as_often_as_they_are_there(spark):
    txs, ins, outs = wire(spark, [(1, 2), (2, 1)])
    twice = txs.unionByName(txs.filter("hash = 't0'"))
    stray = outs.unionByName(outs.limit(1).withColumn("hash", F.lit("nowhere")))
    once = {r["hash"]: bytes(r["raw"]) for r in codec.encode_tx_table(txs, ins, outs).collect()}
    found = {r["hash"]: bytes(r["raw"]) for r in codec.encode_tx_table(twice, ins, stray).collect()}
    assert set(found) == {"t0", "t1"} and found["t1"] == once["t1"]
    head, spent, count, made, tail = once["t0"][:5], once["t0"][5:46], once["t0"][46:47], once["t0"][47:-4], once["t0"][-4:]
    first, second = made[:10], made[10:]
    assert found["t0"] == head * 2 + spent + count * 2 + first * 2 + second * 2 + tail * 2


def test_digits_that_are_no_bytes_stay_as_they_were(spark):
    txs, ins, outs = wire(spark, [(0, 1)])
    odd = outs.withColumn("script_hex", F.lit("zz"))
    assert codec.encode_tx_table(txs, ins, odd).first()["raw"] is None


def test_whole_transactions_are_not_shuffled_for_a_few_large_ones(spark):
    raw = spark.createDataFrame([("a", 0, b"1"), ("b", 0, b"2"), ("b", 1, b"3")], "hash string, chunk long, raw binary")
    found = codec.whole_transactions(raw)
    assert {r["hash"]: bytes(r["raw"]) for r in found.collect()} == {"a": b"1", "b": b"23"}
    assert "SortMergeJoin" not in plan(found) and "SortMergeJoin" not in plan(codec.txids(raw))


def test_written_tables_are_packed_by_an_entropy_coder(spark, tmp_path, monkeypatch):
    hashes = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    places = iter([f"{tmp_path}/a"])
    monkeypatch.setattr(session, "new_path", lambda *_: next(places))
    assert session.materialize(hashes, "hashes").count() == 20_000
    size = sum(f.stat().st_size for f in (tmp_path / "a").glob("*.parquet"))
    assert size < 20_000 * 64 * 0.7


def test_transactions_without_elements_are_found_by_their_owners(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "hash string")
    elements = spark.createDataFrame([("a", 1)], "hash string, n int")
    found = lookups.with_elements(rows, elements, "hash", elements.select("hash")).collect()
    assert sorted(tuple(r) for r in found) == [("a", 1), ("b", None)]


def test_new_rows_of_a_stream_are_not_shuffled_for_a_few_known_hashes(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "hash string, n int")
    known = spark.createDataFrame([("b",), ("b",), (None,)], "hash string")
    found = ingest._drop_hashes(rows, known)
    assert sorted(r["n"] for r in found.collect()) == [1, 2, 4]
    assert "SortMergeJoin" not in plan(found)


def test_packed_texts_come_back_and_keep_their_differences(spark):
    texts = ["", "ab", "AB", "abc", "ab00", "zz", "ab\n", "é", "\1", "\0", "00" * 3000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = hashing.restored(hashing.short(df), df)
    assert sorted(str(r["t"]) for r in back.collect()) == sorted(map(str, texts))
    sizes = {r["t"]: r["n"] for r in df.select("t", F.octet_length(hashing.packed(F.col("t"))).alias("n")).collect()}
    assert sizes["00" * 3000] == 3001 and sizes["ab"] == 2 and sizes["AB"] == 3 and sizes[None] is None
    assert hashing.short(df).distinct().count() == len(texts)


def test_tables_of_the_view_are_written_without_hashes(ledger):
    for name, columns in {"txs": {"hash"}, "outputs": {"hash", "script_hex"}, "inputs": {"hash", "prev_hash"}, "raw": {"hash"}, "mempool": {"hash"}, "collection": {"hash"}}.items():
        table = getattr(ledger, name)
        assert columns <= set(table.columns)
        written = {f for path in table.inputFiles() for f in pq.read_schema(path.removeprefix("file://")).names}
        assert written and not columns & written


def test_texts_move_as_bytes_into_stored_tables(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "hash string, name string, tx string", ["hash", "name"])
    rows = spark.createDataFrame([("aa", "n", "0102", 2), ("aa", "n", "0101", 2), ("aa", "n", "zz", 1), ("bb", "n", "00", 1), ("bb", "N", None, 1)], "hash string, name string, tx string, at int")
    table.upsert(spark.createDataFrame([("bb", "n", "ff")], "hash string, name string, tx string"))
    table.insert_once(rows, ["at"])
    assert sorted(map(str, table.read().collect())) == sorted(
        map(str, spark.createDataFrame([("aa", "n", "zz"), ("bb", "n", "ff"), ("bb", "N", None)], "hash string, name string, tx string").collect())
    )
    asked = spark.createDataFrame([("aa",), ("bb",)], "hash string")
    text = plan(table.find(asked, "hash", unique=True))
    assert "unhex(" in text
