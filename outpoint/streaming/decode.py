"""From raw block and transaction bytes to the feed of the ingest.

The raw feed has one row per message: ``block`` with a serialized block,
``tx`` with a loose transaction. Decoding is part of the micro-batch, so the
bytes are read once; what cannot be decoded is set aside with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import codec, hashing
from ..session import materialize
from .ingest import FEED_SCHEMA, LedgerLog, ingest_batch

RAW_SCHEMA = "arrival bigint, kind string, time bigint, submitted boolean, raw binary"


def _feed(df: DataFrame, kind: str, **values) -> DataFrame:
    columns = [c.split() for c in FEED_SCHEMA.split(", ")]
    values["kind"] = F.lit(kind)
    return df.select(*[values.get(name, F.lit(None)).cast(ddl).alias(name) for name, ddl in columns])


def feed_from_bytes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feed (``FEED_SCHEMA``) of raw messages, and (arrival, kind, reason) of the bad ones.

    A block with one bad transaction is bad as a whole.
    """
    sent = raw.filter("kind = 'block'").select(F.col("arrival").alias("offset"), "raw")
    decoded = materialize(codec.decode_block_table(sent).withColumnRenamed("offset", "arrival"), "raw-blocks")
    bad = decoded.filter("fault IS NOT NULL").select("arrival", F.lit("block").alias("kind"), F.col("fault").alias("reason"))
    good = decoded.filter("fault IS NULL").withColumn("block_hash", hashing.block_hash())
    at = F.col("arrival")
    heads = {c: F.col(c) for c in ("prev_hash", "merkle_root", "timestamp", "numtxs")}
    headers = _feed(good.filter("coalesce(blockindex, 0) = 0"), "header", arrival=at, hash=F.col("block_hash"), **heads)

    whole = good.filter("blockindex IS NOT NULL").select(
        "arrival", "block_hash", "blockindex", F.col("timestamp").alias("time"), F.lit(False).alias("submitted"), F.col("raw_tx").alias("raw")
    )
    loose = raw.filter("kind = 'tx'").select("arrival", "time", "submitted", "raw")
    every = whole.unionByName(loose, allowMissingColumns=True).withColumn("_bytes", F.col("raw"))
    txs = codec.decode_tx_table(every)
    own = F.expr("substring(_bytes, 1, int(size))")  # without what stands behind a loose transaction
    txs = materialize(txs.withColumn("hash", hashing.txid(own)).drop("_bytes"), "raw-txs")
    reason = F.lit("not a transaction").alias("reason")
    bad_txs = txs.filter("size IS NULL")
    bad = bad.unionByName(bad_txs.select("arrival", F.when(F.col("block_hash").isNull(), "tx").otherwise("block").alias("kind"), reason))
    txs = txs.filter("size IS NOT NULL")

    common = {c: F.col(c) for c in ("arrival", "hash", "block_hash", "blockindex")}
    heads = {"time": F.col("time"), "submitted": F.col("submitted"), "txsize": F.col("size"), "locktime": F.col("locktime")}
    keep = list(common)
    ins = txs.select(*keep, F.posexplode("vin").alias("n", "e"))
    outs = txs.select(*keep, F.posexplode("vout").alias("n", "e"))
    spent = {"n": F.col("n"), "spent_hash": F.col("e.prev_hash"), "spent_index": F.col("e.prev_index")}
    made = {"n": F.col("n"), "satoshis": F.col("e.value"), "script_hex": hashing.to_hex(F.col("e.script"))}
    parts = [_feed(txs, "tx", **common, **heads), _feed(ins, "in", **common, **spent), _feed(outs, "out", **common, **made)]
    feed = headers
    for part in parts:
        feed = feed.unionByName(part)
    return feed, bad


def ingest_raw_stream(feed: DataFrame, log: LedgerLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the ingest on a streaming feed with ``RAW_SCHEMA``."""

    def apply(df: DataFrame, batch: int) -> None:
        decoded, bad = feed_from_bytes(df)
        log.write("faults", bad, batch)
        ingest_batch(log, decoded, batch)

    return (
        feed.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
