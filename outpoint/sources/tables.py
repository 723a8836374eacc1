"""Scans of the tables at rest, appends, and the keys by which they change.

Tables are Parquet folders; ``collection`` is partitioned by name, so reading
one collection prunes the others. A table that changes by key is a
``KeyedTable``. Rows whose stored hash is no hash are set aside by
``split_undecodable``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import split_undecodable
from ..schemas import TABLES
from .keyed import KeyedTable

# A table that is looked up by another column has that one first.
KEYS = {
    "blocks": ["hash"],
    "orphans": ["hash"],
    "tx": ["hash"],
    "mempool": ["hash"],
    "utxo": ["hash", "pos"],
    "collection": ["hash", "name"],
    "addr": ["ip"],
}


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(_path(folder, name))


def append_table(df: DataFrame, folder: str, name: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy("name") if name == "collection" else writer).parquet(_path(folder, name))


def keyed(spark: SparkSession, folder: str, name: str, keys: list[str] | None = None) -> KeyedTable:
    """A table that changes by key, new or as it stands in the folder."""
    return KeyedTable(spark, _path(folder, name), TABLES[name], keys or KEYS[name])


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """Decodable blocks in height order."""
    return split_undecodable(blocks)[0].orderBy("height")


def scan_tx(tx: DataFrame) -> DataFrame:
    return split_undecodable(tx)[0].select("hash", "height").orderBy("height")


def scan_mempool(mempool: DataFrame) -> DataFrame:
    return split_undecodable(mempool)[0].select("hash", "time").orderBy("time")


def scan_utxo(utxo: DataFrame) -> DataFrame:
    return split_undecodable(utxo)[0]


def scan_collection(collection: DataFrame, name: str) -> DataFrame:
    return split_undecodable(collection.filter(F.col("name") == name))[0].select("hash")


def scan_addr(addr: DataFrame) -> DataFrame:
    return addr.select("ip")
