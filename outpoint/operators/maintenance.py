"""Keyed changes of tables as new frames: current rows and a delta in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import timestamp_as_string
from ..functions.validate import is_hash


def insert_once(current: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``delta`` to append: unknown keys, the first row of each."""
    columns = delta.columns
    rest = [c for c in columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    once = delta.groupBy(*keys).agg(first) if rest else delta.distinct()
    rows = once.select(*[c if c in keys else F.col(f"_first.{c}").alias(c) for c in columns])
    return drop_known(rows, current, keys)


def drop_known(delta: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``delta`` whose key is not in ``known``, the larger table.

    ``known`` is cut down to the keys in question first. When these are few,
    Spark broadcasts them, and the large table is scanned but not shuffled.
    """
    return delta.join(matching(known.select(*on), delta, on), on, "left_anti").select(*delta.columns)


def matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` with a key in ``keys``."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def delete_keys(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return current.join(keys.select(*on).distinct(), on, "left_anti").select(*current.columns)


def split_confirmed(mempool: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confirmed, remaining) rows of the mempool, given the hashes in blocks."""
    hashes = confirmed.select("hash").distinct()
    return mempool.join(hashes, "hash", "left_semi"), mempool.join(hashes, "hash", "left_anti")


def drop_later_duplicates(mempool: DataFrame) -> DataFrame:
    """Rows with the earliest time of their hash; ties stay.

    The earliest time is aggregated on its own, so copies of one hash are
    reduced before the shuffle and never sorted in one task.
    """
    earliest = mempool.groupBy("hash").agg(F.min("time").alias("_earliest"))
    return mempool.join(earliest, "hash").filter(F.col("time") == F.col("_earliest")).select(*mempool.columns)


def connection_rows(events: DataFrame) -> DataFrame:
    """Rows of the connection log from events (seconds, ip, kind)."""
    kinds = F.when(F.col("kind") == "Connected", "Connect").when(F.col("kind") == "Disconnected", "Disconnect")
    return events.select(
        timestamp_as_string(F.col("seconds")).alias("date"), "ip", kinds.alias("event")
    ).filter("event is not null")


def repair_offsets(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Blocks whose offset 0 is replaced by the one found in the file index."""
    found = index.select("hash", F.col("offset").alias("_found"))
    fixed = F.when(F.col("offset") == 0, F.coalesce("_found", "offset")).otherwise(F.col("offset"))
    return blocks.join(found, "hash", "left").withColumn("offset", fixed).select(*blocks.columns)


def split_undecodable(df: DataFrame, column: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows by whether the stored hash is one."""
    good = is_hash(F.col(column))
    return df.filter(good), df.filter(~good)


def repeated_hashes(tx: DataFrame) -> DataFrame:
    """Transactions that were confirmed more than once."""
    return tx.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def orphan_rows(blocks: DataFrame, created_at: Column) -> DataFrame:
    """Headers of blocks that left the chain, as rows of the orphans table."""
    header = ["height", "hash", "version", "prev_hash", "merkle_root", "timestamp", "bits", "nonce"]
    return blocks.select(*header, created_at.alias("created_at"))
