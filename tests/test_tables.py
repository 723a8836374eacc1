import pytest
from pyspark.sql import functions as F

from outpoint.schemas import TABLES
from outpoint.sources import tables


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "tables")
    for name, ddl in TABLES.items():
        tables.append_table(spark.createDataFrame([], ddl), path, name)
    return path


def block(n, name):
    return (n, name, 1, "p", "m", 100 + n, 1, 1, 0, 80, 0)


def test_append_once(spark, h, folder):
    frame = lambda rows: spark.createDataFrame(rows, TABLES["blocks"])
    blocks = tables.keyed(spark, folder + "-keyed", "blocks")
    blocks.insert_once(frame([block(1, h("a")), block(2, h("b")), block(2, h("b"))]), ["height"])
    blocks.insert_once(frame([block(2, h("b")), block(3, h("c"))]), ["height"])
    stored = tables.keyed(spark, folder + "-keyed", "blocks").read()
    assert [r["height"] for r in tables.scan_blocks(stored).collect()] == [1, 2, 3]


def test_undecodable_rows_are_left_out(spark, h, folder):
    rows = [(h("a"), 1, 0, 10, 5), ("nonsense", 1, 1, 10, 5), (h("b")[:-1], 2, 0, 10, 5)]
    tables.append_table(spark.createDataFrame(rows, TABLES["tx"]), folder, "tx")
    assert [tuple(r) for r in tables.scan_tx(tables.read_table(spark, folder, "tx")).collect()] == [(h("a"), 1)]


def test_one_collection_is_one_folder(spark, h, folder):
    rows = [(h(i), f"m{i % 2}", "00") for i in range(6)]
    tables.append_table(spark.createDataFrame(rows, TABLES["collection"]), folder, "collection")
    found = tables.scan_collection(tables.read_table(spark, folder, "collection"), "m1")
    assert {r["hash"] for r in found.collect()} == {h(1), h(3), h(5)}
    assert "PartitionFilters: [isnotnull(name" in found._jdf.queryExecution().executedPlan().toString()


def test_mempool_and_peers(spark, h, folder):
    rows = [(h("b"), 0, 1, 20, "00"), (h("a"), 0, 1, 10, "00")]
    tables.append_table(spark.createDataFrame(rows, TABLES["mempool"]), folder, "mempool")
    stored = tables.read_table(spark, folder, "mempool")
    assert [r["time"] for r in tables.scan_mempool(stored).collect()] == [10, 20]
    tables.append_table(spark.createDataFrame([("1.1.1.1", 1, 8333)], TABLES["addr"]), folder, "addr")
    peers = tables.keyed(spark, folder + "-keyed", "addr")
    peers.upsert(tables.read_table(spark, folder, "addr"))
    again = spark.createDataFrame([("1.1.1.1", 5, 8333), ("2.2.2.2", 5, 8333)], TABLES["addr"])
    peers.insert_once(again, ["services"])
    stored = peers.read()
    assert sorted(r["ip"] for r in tables.scan_addr(stored).collect()) == ["1.1.1.1", "2.2.2.2"]
    assert stored.filter(F.col("ip") == "1.1.1.1").first()["services"] == 1
