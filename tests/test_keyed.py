"""Keyed tables against a dictionary: changes in any order, versions, failures, and what a lookup opens."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from outpoint.schemas import TABLES
from outpoint.sources.keyed import ConcurrentChange, KeyedTable


@pytest.fixture
def utxo(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "utxo"), TABLES["utxo"], ["hash", "pos"])


def rows(spark, items, more=""):
    return spark.createDataFrame(items, TABLES["utxo"] + more)


def stored(df):
    return {(r["hash"], r["pos"]): (r["satoshis"], r["height"]) for r in df.collect()}


def size(folder, prefix):
    return sum(p.stat().st_size for d in pathlib.Path(folder).glob(f"{prefix}-*") for p in d.rglob("*.parquet"))


def test_changes_in_any_order_equal_a_dictionary(spark, utxo, h):
    draw = random.Random(7)
    model, history = {}, {0: {}}
    for step in range(9):
        what = draw.choice(["upsert", "upsert", "delete", "height", "compact"]) if step else "upsert"
        if what == "upsert":
            items = [(h(draw.randint(0, 25)), draw.randint(0, 1), draw.randint(1, 99), draw.randint(-1, 6), "p", i) for i in range(20)]
            utxo.upsert(rows(spark, items, ", seq int"), "seq")
            model = model | {(i[0], i[1]): (i[2], i[3]) for i in items}
        elif what == "delete":
            gone = [(h(draw.randint(0, 25)), draw.randint(0, 1)) for _ in range(8)]
            utxo.delete(spark.createDataFrame(gone, "hash string, pos bigint"), ["hash", "pos"])
            model = {k: v for k, v in model.items() if k not in gone}
        elif what == "height":
            at = draw.randint(-1, 6)
            utxo.delete(spark.createDataFrame([(at,), (None,)], "height int"), ["height"])
            model = {k: v for k, v in model.items() if v[1] != at}
        else:
            utxo.compact()
        history[utxo.manifest()["version"]] = dict(model)
        assert stored(utxo.read()) == model
        asked = [h(i) for i in range(0, 30, 3)]
        found = utxo.find(spark.createDataFrame([(x,) for x in asked], "hash string"), "hash")
        assert stored(found) == {k: v for k, v in model.items() if k[0] in asked}
    for version, then in history.items():
        assert stored(utxo.read(version)) == then


def test_a_change_writes_what_it_changes(spark, utxo):
    large = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("satoshis"), F.lit(-1).alias("height"), F.lit("p").alias("pubkeyhash"))
    utxo.upsert(large)
    before = size(utxo.folder, "rows")
    files = {p: p.stat().st_mtime_ns for p in pathlib.Path(utxo.folder).rglob("rows-*/*.parquet")}
    utxo.upsert(large.filter("satoshis < 60").withColumn("height", F.lit(5)))
    utxo.delete(large.filter("satoshis between 50 and 99").select("hash", "pos"), ["hash", "pos"])
    utxo.delete(spark.createDataFrame([(-1,)], "height int").limit(0), ["height"])
    assert size(utxo.folder, "rows") - before < before / 50 and size(utxo.folder, "gone") < before / 50
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert utxo.read().count() == 59_950 and utxo.read().filter("height = 5").count() == 50
    assert not utxo.due()
    utxo.upsert(large.filter("satoshis < 30000").withColumn("height", F.lit(6)))
    assert utxo.due()
    utxo.compact()
    assert [p["kind"] for p in utxo.manifest()["parts"]] == ["rows"] and not utxo.due()
    utxo.vacuum()
    assert len(list(pathlib.Path(utxo.folder).glob("rows-*"))) == 1 == len(utxo.versions())
    assert utxo.read().count() == 59_950 + 50


def test_a_lookup_opens_the_files_of_its_keys(spark, utxo, monkeypatch):
    monkeypatch.setattr(KeyedTable, "_write", _many_files(KeyedTable._write))
    large = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("satoshis"), F.lit(-1).alias("height"), F.lit("p").alias("pubkeyhash"))
    utxo.upsert(large)
    utxo.upsert(large.filter("satoshis < 500").withColumn("height", F.lit(9)))
    parts = utxo.manifest()["parts"]
    assert [p["files"] for p in parts] == [40, 40]
    keys = large.filter("satoshis in (3, 777, 1999, 4000, 19999)").select("hash").unionByName(spark.createDataFrame([("no such",), (None,)], "hash string"))
    files = utxo.candidates(keys.filter("hash is not null"), "hash", parts)
    assert 1 <= len(files[parts[0]["path"]]) <= 5 and sum(map(len, files.values())) <= 10
    found = utxo.find(keys, "hash")
    opened = {f.rsplit("/", 1)[1] for f in found.inputFiles() if "rows-" in f}
    assert opened <= {f for names in files.values() for f in names}
    assert {(r.satoshis, r.height) for r in found.collect()} == {(3, 9), (777, -1), (1999, -1), (4000, -1), (19999, -1)}
    with pytest.raises(ValueError):
        utxo.find(keys, "pubkeyhash")


def _many_files(write):
    def run(self, df, kind, on, turn):
        spark = df.sparkSession
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            return write(self, df, kind, on, turn)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    return run


def test_a_failed_change_leaves_no_trace(spark, utxo, h, monkeypatch):
    utxo.upsert(rows(spark, [(h(1), 0, 5, 1, "p")]))
    other = KeyedTable(spark, utxo.folder, utxo.ddl, utxo.keys)
    publish = KeyedTable._publish
    monkeypatch.setattr(KeyedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        utxo.upsert(rows(spark, [(h(1), 0, 9, 9, "p"), (h(2), 0, 9, 9, "p")]))
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    assert stored(other.read()) == {(h(1), 0): (5, 1)}
    base = utxo.manifest()
    other.delete(spark.createDataFrame([(h(1),)], "hash string"), ["hash"])
    with pytest.raises(ConcurrentChange):
        utxo._publish(base, [])
    assert stored(utxo.read()) == {}
    utxo.vacuum()
    assert len(list(pathlib.Path(utxo.folder).glob("rows-*"))) == 1


def test_insert_once_and_heights(spark, tmp_path, h):
    blocks = KeyedTable(spark, str(tmp_path / "blocks"), TABLES["blocks"], ["height", "hash"])
    block = lambda n, name, t=0: (n, h(name), 1, "p", "m", 100 + t, 1, 1, 0, 80, 0)
    frame = lambda items: spark.createDataFrame(items, TABLES["blocks"])
    assert blocks.read().count() == 0 and blocks.find(frame([block(1, "a")]), "hash").count() == 0
    blocks.insert_once(frame([block(1, "a", 2), block(1, "a", 1), block(25_000, "b")]), ["timestamp"])
    version = blocks.insert_once(frame([block(1, "a", 9), block(25_000, "b", 9)]), ["timestamp"])
    assert version == 1  # nothing new, nothing written
    blocks.insert_once(frame([block(1, "a", 9), block(3, "c")]), ["timestamp"])
    assert sorted((r["height"], r["timestamp"]) for r in blocks.read().collect()) == [(1, 101), (3, 100), (25_000, 100)]
    by_height = blocks.find(spark.createDataFrame([(25_000,), (7,)], "height bigint"), "height")
    assert [r["hash"] for r in by_height.collect()] == [h("b")]
    by_hash = blocks.find(spark.createDataFrame([(h("c"),)], "hash string"), "hash")
    assert [r["height"] for r in by_hash.collect()] == [3]
