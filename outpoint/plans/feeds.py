"""Inputs for sources, sinks and streams, derived from the tables of a ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import utc_to_epoch
from ..functions.scripts import BASE58_DIGITS, lock_script
from ..operators import monitors
from ..session import compact_writer, new_path, passing, remove
from ..sources import blockfile
from ..streaming.ingest import FEED_SCHEMA, LedgerLog, ingest_stream
from .view import FIRST_HEIGHT, MONITORS, Ledger, pubkeyhash_of, tagged_hash, tx_hash

# Fixed values of the view.
CUT = 883612800
NOW = 1009843200
START_HASH = hashlib.sha256(f"b:{FIRST_HEIGHT - 1}".encode()).hexdigest()
START_HEIGHT = FIRST_HEIGHT - 1
PEER_PORT = 8333


def keys(ledger: Ledger) -> DataFrame:
    """Every transaction hash, and as many that exist nowhere."""
    return keys_of(ledger.txs)


def keys_of(txs: DataFrame) -> DataFrame:
    unknown = txs.select(tagged_hash("no tx:", F.col("okey")).alias("hash"))
    return txs.select(tx_hash(F.col("okey")).alias("hash")).unionByName(unknown)


def peers(ledger: Ledger) -> DataFrame:
    return peer_events(ledger.source("events"))


def peer_events(events: DataFrame) -> DataFrame:
    """Peer events from rows of the ``events`` table."""
    kind = F.when(F.col("event_type") == "signup", "Connected").when(F.col("event_type") == "error", "Disconnected")
    code = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2)
    user = F.col("user_id")
    octets = [F.lit("10"), F.lit("0"), F.floor(user / 256).cast("string"), (user % 256).cast("string")]
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        utc_to_epoch(F.col("ts")).alias("seconds"),
        "user_id",
        F.concat_ws(".", *octets).alias("ip"),
        (F.col("event_id") % 2048).alias("services"),
        F.lit(PEER_PORT).alias("port"),
        kind.otherwise("Inv").alias("kind"),
        code.when(F.col("event_type") == "click", 3).alias("code"),
    )


def dirty_hashes(ledger: Ledger) -> DataFrame:
    """Transaction hashes as users may write them, good and bad."""
    shown = tagged_hash("tx:", F.col("o_orderkey"))
    value = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.upper(shown))
        .when(F.col("o_orderpriority") == "2-HIGH", F.expr("substr(sha2(concat('tx:', o_orderkey), 256), 2)"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(shown, F.lit("\n")))
        .when(
            F.col("o_orderpriority") == "4-NOT SPECIFIED",
            F.concat(F.lit("g"), F.expr("substr(sha2(concat('tx:', o_orderkey), 256), 2)")),
        )
        .otherwise(shown)
    )
    return ledger.source("orders").select(F.col("o_orderkey").alias("okey"), value.alias("value"))


def static_monitors(ledger: Ledger) -> DataFrame:
    prefix = F.concat(F.lit("76a914"), F.substring(tagged_hash("n:", F.col("n_nationkey")), 1, 2))
    return ledger.source("nation").select(
        F.col("n_nationkey").cast("long").alias("position"),
        F.col("n_name").alias("name"),
        (F.col("n_regionkey") == 1).alias("track_descendants"),
        F.lit(None).cast("string").alias("address"),
        F.when(F.col("n_regionkey") != 2, prefix).alias("locking_script_pattern"),
    )


def dynamic_monitors(ledger: Ledger) -> DataFrame:
    owner = F.substring(tagged_hash("s:", F.col("s_suppkey")), 1, 40)
    return ledger.source("supplier").select(
        F.col("s_suppkey").cast("long").alias("position"),
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("name"),
        (F.col("s_nationkey") == 1).alias("track_descendants"),
        F.lit(None).cast("string").alias("address"),
        lock_script(owner).alias("locking_script_pattern"),
    )


def _address(version: int, key_hash: str) -> str:
    body = bytes([version]) + bytes.fromhex(key_hash)
    body += hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4]
    number, digits = int.from_bytes(body, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        digits = BASE58_DIGITS[digit] + digits
    return BASE58_DIGITS[0] * (len(body) - len(body.lstrip(b"\0"))) + digits


def customer_addresses(ledger: Ledger, damaged: bool = True) -> DataFrame:
    """(c_custkey, address): of debtors with a wrong last character.

    Addresses in the segment ``BUILDING`` are of another type.
    """
    version = F.when(F.col("c_mktsegment") == "BUILDING", 0xC4).otherwise(0x6F)
    rows = ledger.source("customer").select(
        "c_custkey",
        pubkeyhash_of(F.col("c_custkey")).alias("key_hash"),
        version.alias("version"),
        (F.col("c_acctbal") < 0).alias("debtor"),
    )

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out = []
            for _, key_hash, number, debtor in zip(*columns):
                text = _address(number, key_hash)
                if debtor and damaged:
                    text = text[:-1] + ("2" if text[-1] == "1" else "1")
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["c_custkey", "address"])

    return rows.mapInArrow(spell, "c_custkey bigint, address string")


def block_file(ledger: Ledger, segment_bytes: int = blockfile.SEGMENT_BYTES) -> tuple[str, DataFrame]:
    """Path of a raw file with all blocks, and the places of its pieces."""
    path = new_path(ledger.spark, "blockfile")
    return path, blockfile.write_block_file(ledger.wire_blocks, path, segment_bytes)


def scaled_values(satoshis: Column) -> Column:
    """Output values spread over and beyond the legal range."""
    return (satoshis - 1_000_000) * 300_000_000


def feed_rows(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    """Rows of the ingest feed; what is not given is null."""
    values["kind"] = F.lit(kind)
    columns = [c.split() for c in FEED_SCHEMA.split(", ")]
    return df.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in columns])


def ingest_feed(ledger: Ledger) -> list[DataFrame]:
    """The ledger as a feed, in the order its parts arrive.

    Blocks come shuffled, with forks; then every header is announced again;
    loose transactions come last.
    """
    rows = feed_rows
    arrived = ledger.arrivals.withColumn("at", (F.col("arrival") * 2).cast("long"))
    heads = ledger.blocks.select("height", "merkle_root", "numtxs")
    blocks = arrived.join(heads, "height")
    header = {c: F.col(c) for c in ("hash", "prev_hash", "merkle_root", "timestamp", "numtxs")}
    first = rows(blocks, "header", arrival=F.col("at"), **header)
    again = rows(blocks, "header", arrival=F.col("at") + 50_000, **header)
    owners = arrived.join(ledger.blocks.select("hash"), "hash", "left_semi").select(
        "height", F.col("hash").alias("block_hash"), "at"
    )

    def place(df: DataFrame) -> DataFrame:
        confirmed = df.filter("height >= 0").join(owners, "height")
        loose = df.filter("height < 0").withColumn("at", F.col("seq"))
        return confirmed.unionByName(loose, allowMissingColumns=True)

    common = {
        "arrival": F.col("at"),
        "hash": F.col("hash"),
        "block_hash": F.col("block_hash"),
        "blockindex": F.col("blockindex"),
    }
    txs = rows(
        place(ledger.tx_sizes.select("hash", "height", "blockindex", "seq", "time", "txsize", "submitted")),
        "tx",
        submitted=F.col("submitted"),
        time=F.col("time"),
        txsize=F.col("txsize"),
        locktime=F.lit(0),
        **common,
    )
    ins = rows(
        place(ledger.inputs),
        "in",
        n=F.col("vin"),
        spent_hash=F.col("prev_hash"),
        spent_index=F.col("prev_index"),
        **common,
    )
    outs = rows(
        place(ledger.outputs.drop("okey")),
        "out",
        n=F.col("pos"),
        satoshis=F.col("satoshis"),
        script_hex=F.col("script_hex"),
        **common,
    )
    whole = first.unionByName(txs).unionByName(ins).unionByName(outs)
    early, late = F.col("arrival") < 10_000, F.col("arrival") < 50_000
    return [
        whole.filter(early),
        whole.filter(~early & late).unionByName(again.filter(F.col("arrival") < 60_000)),
        whole.filter(~late).unionByName(again.filter(F.col("arrival") >= 60_000)),
    ]


def run_ingest(ledger: Ledger) -> LedgerLog:
    """Stream the feed into log tables, one micro-batch per part."""
    log = LedgerLog(ledger.spark, new_path(ledger.spark, "log"), START_HASH, START_HEIGHT, MONITORS).start()
    return _streamed(ledger, ingest_feed(ledger), lambda: log)


def _streamed(ledger: Ledger, parts: list[DataFrame], log_of: Callable[[], LedgerLog]) -> LedgerLog:
    """One micro-batch per part, each after a restart; files go when their batch is done."""
    landing, checkpoint = new_path(ledger.spark, "feed"), new_path(ledger.spark, "feed-state")
    for part in parts:
        with passing(ledger.spark):
            compact_writer(part).mode("append").parquet(landing)
        feed = ledger.spark.readStream.schema(FEED_SCHEMA).parquet(landing)
        ingest_stream(feed, log_of(), checkpoint).awaitTermination()
        remove(ledger.spark, landing)
    return log_of()


def run_late_block(ledger: Ledger, ingested: LedgerLog, keep_balances: bool = False) -> LedgerLog:
    """The ingested ledger, then an empty message, then a block older than all others."""
    folder = new_path(ledger.spark, "log-late")
    with passing(ledger.spark):
        ingested.restart(folder, ingested.state(), -1, keep_balances)
    first = ledger.blocks.agg(F.min("timestamp").alias("timestamp"))
    at, late = F.lit(1 << 62), tagged_hash("late:", F.col("timestamp"))
    header = {"hash": late, "prev_hash": late, "merkle_root": late, "timestamp": F.col("timestamp") - 1, "numtxs": F.lit(0)}
    parts = [feed_rows(first, "nothing", arrival=at - 1), feed_rows(first, "header", arrival=at, **header)]
    place = (ledger.spark, folder, START_HASH, START_HEIGHT, MONITORS, 10)
    return _streamed(ledger, parts, lambda: LedgerLog(*place, keep_balances=keep_balances))


def run_monitor_changes(ledger: Ledger, at: int) -> LedgerLog:
    """All transactions as loose ones; one monitor comes at an arrival and another one, which was there before, goes."""
    outs = feed_rows(
        ledger.outputs, "out", arrival=F.col("seq"), hash=F.col("hash"), n=F.col("pos"), satoshis=F.col("satoshis"), script_hex=F.col("script_hex")
    )
    txs = feed_rows(ledger.txs, "tx", arrival=F.col("seq"), hash=F.col("hash"), time=F.col("time"), locktime=F.lit(0), txsize=F.lit(0))
    start = ledger.txs.agg(F.min("seq").alias("seq"))

    def change(kind: str, rule: monitors.Monitor, arrival: Column) -> DataFrame:
        return feed_rows(start, kind, arrival=arrival, name=F.lit(rule.name), locking_script_pattern=F.lit(rule.locking_script_pattern))

    whole = outs.unionByName(txs)
    comes, goes = MONITORS[0], MONITORS[2]
    half = F.col("arrival") < at
    early = whole.filter(half).unionByName(change("monitor_add", goes, F.col("seq")))
    late = whole.filter(~half).unionByName(change("monitor_add", comes, F.lit(at))).unionByName(change("monitor_delete", goes, F.lit(at)))
    folder = new_path(ledger.spark, "log-monitors")
    LedgerLog(ledger.spark, folder, START_HASH, START_HEIGHT).start()
    return _streamed(ledger, [early, late], lambda: LedgerLog(ledger.spark, folder, START_HASH, START_HEIGHT))
