"""One query per operator, over the ledger view of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, display, hashing, scripts, validate
from ..operators import chain, lookups, maintenance, merkle, monitors, utxo
from ..operators.ordering import row_position
from ..schemas import TABLES
from ..session import materialize, new_path, passing
from ..sources import blockfile, tables
from ..sources.keyed import KeyedTable
from ..streaming import events as event_stream
from ..streaming import throttle
from ..streaming.ingest import rebuild
from . import feeds
from .feeds import CUT, NOW, START_HASH, START_HEIGHT
from .view import MONITORS, Ledger, pubkeyhash_of, tagged_hash, tx_hash

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
    """Register ``fn``; its name is the key."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(Ledger.of(spark, folder))
    return fn


def _once(ledger: Ledger, name: str, make: Callable[[Ledger], object]):
    """Something made once per ledger, such as a file or a finished stream."""
    if name not in ledger.kept:
        ledger.kept[name] = make(ledger)
    return ledger.kept[name]


def _block_file(ledger: Ledger) -> tuple[str, DataFrame]:
    """Path of the raw block file and its block index."""
    path, pieces = _once(ledger, "block_file", feeds.block_file)
    return path, blockfile.block_index(pieces)


def _ingested(ledger: Ledger):
    return _once(ledger, "ingested", feeds.run_ingest)


def _old(df: DataFrame, time: str = "time") -> DataFrame:
    return df.filter(F.col(time) < CUT)


def _tx_with_time(L: Ledger) -> DataFrame:
    return L.tx.join(L.blocks.select("height", F.col("timestamp").alias("time")), "height")


def _raw_hex(L: Ledger) -> DataFrame:
    """hash, tx: serialized transactions as hex."""
    return codec.whole_transactions(L.raw).select("hash", hashing.to_hex(F.col("raw")).alias("tx"))


# Sources


def _digests(blocks: DataFrame) -> DataFrame:
    return blocks.select("offset", "size", F.sha2("raw", 256).alias("digest"))


@query
def s1_read_blocks(L: Ledger) -> DataFrame:
    return _digests(blockfile.read_blocks(L.spark, _block_file(L)[0]))


@query
def s2_index_blocks(L: Ledger) -> DataFrame:
    return blockfile.index_blocks(L.spark, _block_file(L)[0]).drop("path")


@query
def s2_frame_blocks(L: Ledger) -> DataFrame:
    """The index of a file whose kept starts are not used: every task guesses its own."""
    found = blockfile.index_blocks(L.spark, _block_file(L)[0], kept_starts=False, range_bytes=4 << 20)
    return found.drop("path")


@query
def s3_fetch_blocks(L: Ledger) -> DataFrame:
    path, index = _block_file(L)
    return _digests(blockfile.fetch_blocks(index, path))


@query
def s4_scan_blocks(L: Ledger) -> DataFrame:
    return tables.scan_blocks(L.blocks)


@query
def s5_scan_tx(L: Ledger) -> DataFrame:
    return tables.scan_tx(L.tx)


@query
def s6_scan_mempool(L: Ledger) -> DataFrame:
    return tables.scan_mempool(L.mempool)


@query
def s7_scan_utxo(L: Ledger) -> DataFrame:
    return tables.scan_utxo(L.utxo)


@query
def s8_scan_collection(L: Ledger) -> DataFrame:
    return tables.scan_collection(L.collection, "CoCv1")


def _addr(L: Ledger) -> DataFrame:
    seen = feeds.peers(L).select("ip", "services", "port", "ts", "event_id")
    none = seen.limit(0)
    return maintenance.insert_once(none, seen, ["ip"], ["ts", "event_id"]).select("ip", "services", "port")


@query
def s9_scan_addr(L: Ledger) -> DataFrame:
    return tables.scan_addr(_addr(L))


def _event_source(L: Ledger) -> DataFrame:
    # As a glob the name may be that of one file or of a folder of files.
    schema = L.source("events").schema
    return L.spark.readStream.schema(schema).parquet(f"{L.folder.rstrip('/')}/events.parque[t]")


def _routed(L: Ledger, name: str, kinds: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stream the events once and read back what the handlers wrote."""
    folder = new_path(L.spark, name)
    parts = {kind: f"{folder}/{kind}" for kind in kinds}
    handlers = {kind: event_stream.append_batches(path, make) for kind, path in parts.items()}
    typed = feeds.peer_events(_event_source(L)).withColumnRenamed("kind", "event_type")
    event_stream.route_stream(typed, handlers, f"{folder}-state").awaitTermination()
    read = [L.spark.read.parquet(path).drop("batch") for path in parts.values()]
    out = read[0]
    for part in read[1:]:
        out = out.unionByName(part)
    return out


@query
def s10_event_routes(L: Ledger) -> DataFrame:
    return _routed(
        L, "routes", ["Connected", "Disconnected", "Inv"], lambda df: df.select("event_type", "event_id")
    )


def _monitor_list(L: Ledger) -> DataFrame:
    return monitors.monitor_order(feeds.static_monitors(L), feeds.dynamic_monitors(L))


@query
def s11_monitor_source(L: Ledger) -> DataFrame:
    return _monitor_list(L)


# Table maintenance: rows before the cut are stored, later ones are new.


def _table(L: Ledger, name: str, rows: DataFrame, keys: list[str] | None = None) -> KeyedTable:
    """A stored table that changes by key, with ``rows``; columns that they lack are null."""
    table = tables.keyed(L.spark, new_path(L.spark, "tables"), name, keys)
    table.upsert(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in table.kinds.items()]))
    return table


def _inserted(table: KeyedTable, delta: DataFrame, order: list[str]) -> DataFrame:
    """What an insert of ``delta`` has added to a stored table."""
    before = table.manifest()["version"]
    table.insert_once(delta, order)
    return table.added(before)


@query
def k1_append_blocks(L: Ledger) -> DataFrame:
    announced = L.blocks.unionByName(L.blocks)
    return _inserted(_table(L, "blocks", _old(L.blocks, "timestamp")), announced, ["height"]).select("hash", "height")


@query
def k2_append_txs(L: Ledger) -> DataFrame:
    return _inserted(_table(L, "tx", _old(_tx_with_time(L))), L.tx, ["height", "blockindex"])


@query
def k3_utxo_upsert(L: Ledger) -> DataFrame:
    made = utxo.created_outputs(L.outputs)
    table = _table(L, "utxo", made.withColumn("height", F.lit(utxo.NOT_IN_BLOCK)))
    table.upsert(made.filter("height >= 0").withColumn("seq", F.col("height").cast("long")), "seq")
    return table.read()


@query
def k4_utxo_delete(L: Ledger) -> DataFrame:
    table = _table(L, "utxo", utxo.created_outputs(L.outputs))
    table.delete(utxo.spent_outpoints(L.inputs), ["hash", "pos"])
    return table.read()


@query
def k5_mempool_insert(L: Ledger) -> DataFrame:
    announced = materialize(L.mempool.join(_raw_hex(L), "hash"), "announced")
    return _inserted(_table(L, "mempool", _old(announced)), announced.unionByName(announced), ["time"])


@query
def k6_mempool_delete(L: Ledger) -> DataFrame:
    table = _table(L, "mempool", L.txs.select("hash", "time"))
    table.delete(L.tx, ["hash"])
    return table.read().select("hash", "time")


@query
def k7_orphan_insert(L: Ledger) -> DataFrame:
    left = L.blocks.filter(F.col("timestamp") >= CUT)
    rows = maintenance.orphan_rows(left, F.current_timestamp())
    return _inserted(_table(L, "orphans", rows.limit(0)), rows, ["created_at"]).drop("created_at")


def _late_blocks(L: Ledger) -> DataFrame:
    return L.blocks.filter(F.col("timestamp") >= CUT)


@query
def k8_delete_blocks(L: Ledger) -> DataFrame:
    table = _table(L, "blocks", L.blocks)
    table.delete(_late_blocks(L), ["hash"])
    return table.read().select("height", "hash")


@query
def k9_delete_txs(L: Ledger) -> DataFrame:
    table = _table(L, "tx", L.tx)
    table.delete(_late_blocks(L), ["height"])
    return table.read()


@query
def k10_delete_utxo(L: Ledger) -> DataFrame:
    table = _table(L, "utxo", L.utxo)
    table.delete(_late_blocks(L), ["height"])
    return table.read()


@query
def k11_collection_insert(L: Ledger) -> DataFrame:
    collected, txs = L.collection, L.txs
    with passing(L.spark):
        timed = materialize(_texts_of(L, collected.join(txs.select("okey", "time"), "okey")), "captured")
        return _inserted(_table(L, "collection", _old(timed)), timed.select("hash", "name", "tx"), [])


def _connections(df: DataFrame) -> DataFrame:
    return maintenance.connection_rows(df)


@query
def k12_connection_log(L: Ledger) -> DataFrame:
    return _connections(feeds.peers(L))


@query
def k13_peer_append(L: Ledger) -> DataFrame:
    seen = feeds.peers(L).select("ip", "services", "port", "ts", "event_id")
    none = seen.limit(0)
    stored = maintenance.insert_once(none, seen.filter("ts < timestamp_ntz'2024-01-01 04:00:00'"), ["ip"], ["ts", "event_id"])
    return _inserted(_table(L, "addr", stored), seen, ["ts", "event_id"])


@query
def k14_write_blocks(L: Ledger) -> DataFrame:
    return _block_file(L)[1]


# Scalar functions


@query
def p1_decode_tx(L: Ledger) -> DataFrame:
    decoded = codec.decode_tx_table(codec.whole_transactions(L.raw))
    spent = decoded.select("hash", F.posexplode("vin").alias("n", "e")).select(
        "hash",
        F.lit("in").alias("kind"),
        F.col("n").cast("long").alias("n"),
        F.col("e.prev_hash").alias("ref"),
        F.col("e.prev_index").alias("amount"),
    )
    made = decoded.select("hash", F.posexplode("vout").alias("n", "e")).select(
        "hash",
        F.lit("out").alias("kind"),
        F.col("n").cast("long").alias("n"),
        hashing.to_hex(F.col("e.script")).alias("ref"),
        F.col("e.value").alias("amount"),
    )
    heads = decoded.select(
        "hash",
        F.lit("tx").alias("kind"),
        F.col("version").cast("long").alias("n"),
        F.lit(None).cast("string").alias("ref"),
        F.col("locktime").alias("amount"),
    )
    return spent.unionByName(made).unionByName(heads)


@query
def p2_encode_tx(L: Ledger) -> DataFrame:
    return codec.encode_tx_table(*L.wire_tables()).select(
        "hash", "chunk", hashing.to_hex(F.col("raw")).alias("tx")
    )


@query
def p3_decode_block(L: Ledger) -> DataFrame:
    path, index = _block_file(L)
    decoded = codec.decode_block_table(blockfile.fetch_blocks(index, path, piece_bytes=codec.WINDOW_BYTES))
    return decoded.select(
        F.col("nonce").alias("height"),
        "blockindex",
        "tx_offset",
        "tx_size",
        hashing.txid(F.col("raw_tx")).alias("txid"),
        "prev_hash",
        "merkle_root",
        "timestamp",
        "numtxs",
    )


@query
def p4_hash256(L: Ledger) -> DataFrame:
    text = F.col("text").cast("binary")
    return L.source("documents").select("doc_id", hashing.to_hex(hashing.hash256(text)).alias("digest"))


@query
def p5_txid(L: Ledger) -> DataFrame:
    return codec.txids(L.raw)


@query
def p6_header_hex(L: Ledger) -> DataFrame:
    return L.blocks.select("height", hashing.header_hex().alias("header"))


@query
def p7_reverse_hex(L: Ledger) -> DataFrame:
    return L.txs.select("hash", hashing.reverse_hex(F.col("hash")).alias("reversed"))


@query
def p8_block_hash(L: Ledger) -> DataFrame:
    return L.blocks.select("height", hashing.block_hash().alias("header_hash"))


@query
def p9_hex(L: Ledger) -> DataFrame:
    encoded = hashing.to_hex(F.col("props").cast("binary"))
    return L.source("events").select(
        "event_id",
        encoded.alias("encoded"),
        hashing.from_hex(encoded).cast("string").alias("decoded"),
        hashing.from_hex(F.col("props")).isNull().alias("rejected"),
    )


@query
def p10_script_to_pubkeyhash(L: Ledger) -> DataFrame:
    return L.outputs.select("hash", "pos", scripts.script_to_pubkeyhash(F.col("script_hex")).alias("pubkeyhash"))


@query
def p11_address_to_pubkeyhash(L: Ledger) -> DataFrame:
    return scripts.address_to_pubkeyhash(feeds.customer_addresses(L)).drop("address")


@query
def p12_address_to_lock_script(L: Ledger) -> DataFrame:
    return scripts.address_to_lock_script(feeds.customer_addresses(L), "testnet").drop("address")


@query
def p13_is_spendable(L: Ledger) -> DataFrame:
    return L.outputs.select("hash", "pos", scripts.is_spendable(F.col("script_hex")).alias("spendable"))


@query
def p14_tx_summary(L: Ledger) -> DataFrame:
    return utxo.tx_summary(L.raw, L.outputs)


@query
def p15_block_summary(L: Ledger) -> DataFrame:
    return utxo.block_summary(L.wire_blocks)


@query
def p16_block_record(L: Ledger) -> DataFrame:
    return L.blocks.select(*display.block_record())


@query
def p17_mempool_record(L: Ledger) -> DataFrame:
    return L.mempool.select(*display.mempool_record())


@query
def p18_tx_record(L: Ledger) -> DataFrame:
    decoded = codec.decode_tx_table(codec.whole_transactions(L.raw))
    return decoded.select("hash", codec.tx_record(decoded).alias("record"))


@query
def p19_block_summary_record(L: Ledger) -> DataFrame:
    return lookups.block_summary_records(L.blocks, L.tx)


@query
def p20_timestamp_as_string(L: Ledger) -> DataFrame:
    return feeds.peers(L).select("event_id", display.timestamp_as_string(F.col("seconds")).alias("shown"))


@query
def p21_delay_as_string(L: Ledger) -> DataFrame:
    return L.txs.select("hash", display.delay_as_string(F.lit(NOW) - F.col("time")).alias("delay"))


@query
def p22_timestamp_age(L: Ledger) -> DataFrame:
    return L.txs.select("hash", display.timestamp_age_sec(F.col("time"), F.lit(CUT)).alias("age"))


@query
def p23_decode_services(L: Ledger) -> DataFrame:
    names = F.array_join(display.decode_services(F.col("services")), ",")
    return feeds.peers(L).select("event_id", names.alias("services"))


@query
def p24_inv_type_name(L: Ledger) -> DataFrame:
    return L.source("events").select("event_id", display.inv_type_name(F.col("event_id") % 6).alias("type"))


@query
def p25_compact_to_target(L: Ledger) -> DataFrame:
    bits = F.col("l_linenumber").cast("long") * (1 << 24) + F.col("l_partkey") % (1 << 24)
    distinct = L.source("lineitem").select(bits.alias("bits")).distinct()
    return distinct.select("bits", hashing.compact_to_target(F.col("bits")).alias("target"))


@query
def p26_outpoint(L: Ledger) -> DataFrame:
    return L.inputs.select(
        "hash", "vin", display.outpoint_to_str(F.col("prev_hash"), F.col("prev_index")).alias("prevout")
    )


# Validation


def _verdict(df: DataFrame, key: str, check: Column) -> DataFrame:
    return df.select(key, check.alias("_c")).select(key, "_c.valid", "_c.reason", "_c.value")


@query
def v1_check_hash(L: Ledger) -> DataFrame:
    return _verdict(feeds.dirty_hashes(L), "okey", validate.check_hash(F.col("value")))


@query
def v2_check_height(L: Ledger) -> DataFrame:
    height = F.col("o_orderkey") * 7919 - 100000
    return _verdict(L.source("orders"), "o_orderkey", validate.check_height(height))


@query
def v3_check_monitor_name(L: Ledger) -> DataFrame:
    customer = L.source("customer")
    tidy = customer.select("c_custkey", F.replace(F.col("c_name"), F.lit("#"), F.lit("-")).alias("c_name"))
    both = customer.select("c_custkey", "c_name").unionByName(tidy)
    return _verdict(both, "c_custkey", validate.check_monitor_name(F.col("c_name")))


@query
def v4_check_hex(L: Ledger) -> DataFrame:
    digits = F.hex(F.col("props").cast("binary"))
    kind = F.col("event_type")
    value = (
        F.when(kind == "view", digits)
        .when(kind == "click", F.expr("substr(hex(cast(props as binary)), 2)"))
        .when(kind == "error", "")
        .otherwise(F.col("props"))
    )
    return _verdict(L.source("events"), "event_id", validate.check_hex(value))


@query
def v5_check_tx_size(L: Ledger) -> DataFrame:
    return _verdict(_raw_hex(L), "hash", validate.check_tx_hex(F.col("tx"), 300))


@query
def v6_check_pattern(L: Ledger) -> DataFrame:
    return _verdict(L.source("documents"), "doc_id", validate.check_pattern(F.col("text"))).drop("value")


@query
def v7_tx_values(L: Ledger) -> DataFrame:
    legal = validate.value_in_range(feeds.scaled_values(F.col("satoshis")))
    return L.outputs.groupBy("hash").agg(F.bool_and(legal).alias("valid"))


def _proof_of_work() -> Column:
    return hashing.meets_target(hashing.block_hash(), hashing.compact_to_target(F.col("bits")))


@query
def v8_proof_of_work(L: Ledger) -> DataFrame:
    return L.blocks.select("height", _proof_of_work().alias("valid"))


@query
def v9_block_valid(L: Ledger) -> DataFrame:
    bad = L.outputs.filter((F.col("height") >= 0) & ~validate.value_in_range(F.col("satoshis")))
    return merkle.check_blocks(L.blocks, merkle.merkle_roots(L.tx), bad, _proof_of_work())


@query
def v10_quarantine(L: Ledger) -> DataFrame:
    stored = feeds.dirty_hashes(L).withColumnRenamed("value", "hash")
    good, bad = maintenance.split_undecodable(stored)
    return good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))


@query
def v11_duplicate_tx(L: Ledger) -> DataFrame:
    """Each fork block confirms the transactions of its sibling again."""
    carried = L.arrivals.join(L.tx.select(F.col("hash").alias("txid"), "height"), "height")
    return maintenance.repeated_hashes(carried.select(F.col("txid").alias("hash")))


@query
def v12_monitor_checks(L: Ledger) -> DataFrame:
    static, dynamic = feeds.static_monitors(L), feeds.dynamic_monitors(L)
    asked = static.unionByName(dynamic.withColumn("position", F.col("position") + 1_000_000))
    added = monitors.check_monitors(asked, dynamic).withColumn("action", F.lit("add"))
    strangers = L.source("customer").select(
        (F.col("c_custkey") + 2_000_000).alias("position"),
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("name"),
    )
    names = asked.select("position", "name").unionByName(strangers)
    deleted = monitors.check_deletes(names, static, dynamic).withColumn("action", F.lit("delete"))
    return added.unionByName(deleted)


# Joins


@query
def j1_utxo_set(L: Ledger) -> DataFrame:
    return utxo.utxo_set(L.outputs, L.inputs)


@query
def j2_tx_fee(L: Ledger) -> DataFrame:
    return utxo.fees(L.txs, L.inputs, L.outputs)


STORED = {"tx": ["hash"], "mempool": ["hash"], "collection": ["hash", "name"], "utxo": ["hash", "pos"], "blocks": ["height", "hash"]}


def stored_tables(L: Ledger) -> None:
    """Write all tables that lookups read."""
    for name in STORED:
        _stored(L, name)
    _stored_by_height(L)
    _trees(L)


def _trees(L: Ledger) -> KeyedTable:
    """The folded chunks of all blocks."""

    def make(ledger: Ledger) -> KeyedTable:
        trees = KeyedTable(ledger.spark, new_path(ledger.spark, "trees"), merkle.TREES, merkle.TREE_KEYS)
        trees.upsert(merkle.tree_rows(ledger.tx))
        return trees

    return _once(L, "trees", make)


def _stored(L: Ledger, name: str) -> KeyedTable:
    """A table as it is at rest, written once; lookups find the files of their keys in it."""
    rows = {"collection": _collection_text}.get(name, lambda ledger: getattr(ledger, name))
    return _once(L, f"stored-{name}", lambda ledger: _table(ledger, name, rows(ledger), STORED[name]))


def _captured(L: Ledger) -> KeyedTable:
    """The hashes and names of the collection as an index on the hash; like those of the mempool its rows have no text."""
    return _once(L, "stored-captured", lambda ledger: _table(ledger, "collection", ledger.collection, STORED["collection"]))


def _stored_by_height(L: Ledger) -> KeyedTable:
    """The transactions in the order of the chain, as the index on (height, blockindex) has them."""
    return _once(L, "stored-order", lambda ledger: _table(ledger, "tx", ledger.tx, ["height", "blockindex", "hash"]))


def _asked(L: Ledger) -> DataFrame:
    """The distinct keys in question, written as order keys."""
    return feeds.keys_of(materialize(L.txs.select("okey").distinct(), "asked"))


def _placed(L: Ledger, keys: DataFrame, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """The transactions of the keys, and the blocks that hold them."""
    placed = materialize(_stored(L, "tx").find(keys, "hash", unique), "placed")
    return placed, _stored(L, "blocks").find(placed, "height")


def _ask_utxo(L: Ledger, keys: DataFrame, answer: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    return answer(keys, _stored(L, "utxo").find(keys, "hash"))


def _listing(L: Ledger, keys: DataFrame, on: str) -> DataFrame:
    blocks = materialize(_stored(L, "blocks").find(keys, on), "listed")
    return lookups.block_listing(keys, blocks, _stored_by_height(L).find(blocks, "height", unique=True), on)


@query
def j3_tx_block_offset(L: Ledger) -> DataFrame:
    keys = feeds.keys(L)
    placed, blocks = _placed(L, keys)
    return lookups.tx_block_offset(keys, placed, blocks)


@query
def j4_tx_block(L: Ledger) -> DataFrame:
    keys = feeds.keys(L)
    placed, blocks = _placed(L, keys)
    return lookups.tx_block(keys, placed, blocks)


@query
def j5_spent_flags(L: Ledger) -> DataFrame:
    return utxo.spent_flags(L.outputs.select("hash", "pos", "script_hex"), L.utxo).drop("script_hex")


@query
def j6_tx_position(L: Ledger) -> DataFrame:
    return lookups.tx_position(feeds.keys(L), _stored(L, "tx").find(feeds.keys(L), "hash"))


@query
def j7_mempool_confirmation(L: Ledger) -> DataFrame:
    confirmed, remaining = maintenance.split_confirmed(L.txs.select("hash"), L.tx)
    return confirmed.withColumn("confirmed", F.lit(True)).unionByName(
        remaining.withColumn("confirmed", F.lit(False))
    )


@query
def j8_tx_exists(L: Ledger) -> DataFrame:
    keys = _asked(L)
    return lookups.tx_exists(keys, *[table.near(keys, "hash") for table in (_stored(L, "tx"), _stored(L, "mempool"), _captured(L))])


@query
def j9_monitor_match(L: Ledger) -> DataFrame:
    return monitors.pattern_matches(L.outputs, MONITORS)


@query
def j10_direct_descendants(L: Ledger) -> DataFrame:
    return monitors.direct_descendants(L.inputs, L.matches.filter("priority = 1"))


@query
def j11_first_match(L: Ledger) -> DataFrame:
    return monitors.own_matches(L.outputs, MONITORS)


@query
def j12_descendant_closure(L: Ledger) -> DataFrame:
    return monitors.assign(L.txs, L.inputs, L.matches, MONITORS)


@query
def j13_mempool_dedup(L: Ledger) -> DataFrame:
    """Every transaction announced twice at once and again a minute later."""
    seen = L.mempool.select("hash", "time")
    later = seen.withColumn("time", F.col("time") + 60)
    return maintenance.drop_later_duplicates(seen.unionByName(later).unionByName(seen))


@query
def j14_offset_repair(L: Ledger) -> DataFrame:
    lost = F.when(F.col("timestamp") < CUT, F.lit(0).cast("long")).otherwise(F.col("offset"))
    return maintenance.repair_offsets(L.blocks.withColumn("offset", lost), L.blocks).select("hash", "offset")


@query
def j15_chain_linkage(L: Ledger) -> DataFrame:
    return chain.order_blocks(L.arrivals.select("hash", "prev_hash", "arrival"), START_HASH, START_HEIGHT)


# Aggregations


@query
def a1_balance(L: Ledger) -> DataFrame:
    return utxo.balances(L.utxo, utxo.tip_height(L.blocks))


@query
def a2_status(L: Ledger) -> DataFrame:
    return lookups.status(L.blocks, L.tx, L.utxo, L.mempool)


@query
def a3_max_height(L: Ledger) -> DataFrame:
    return chain.max_height(L.blocks)


@query
def a4_last_block_time(L: Ledger) -> DataFrame:
    return lookups.status(L.blocks, None, None, None).select("last_block_time")


@query
def a5_start_timestamp(L: Ledger) -> DataFrame:
    few, many = [
        chain.start_timestamp(L.blocks, n).select(F.lit(n).alias("threshold"), "start_timestamp")
        for n in (100, 1_000_000_000)
    ]
    return few.unionByName(many)


@query
def a6_merkle_root(L: Ledger) -> DataFrame:
    return merkle.merkle_roots(L.tx)


@query
def a7_chain_tip_reached(L: Ledger) -> DataFrame:
    newest = F.max_by("timestamp", "height")
    near, far = [
        chain.chain_tip_reached(L.blocks, newest + n).select(F.lit(n).alias("lag_sec"), "caught_up") for n in (599, 600)
    ]
    return near.unionByName(far)


@query
def a8_inventory_counts(L: Ledger) -> DataFrame:
    offered = feeds.peers(L).filter("kind = 'Inv'")
    return lookups.inventory_counts(offered, ["user_id"], F.col("code"))


# Order


@query
def w1_positions(L: Ledger) -> DataFrame:
    confirmed = L.txs.filter(~F.col("is_mem")).select("hash", "height", "okey")
    return row_position(confirmed, ["height"], ["okey"], "blockindex").drop("okey")


@query
def w2_latest_blocks(L: Ledger) -> DataFrame:
    return lookups.latest_blocks(L.blocks)


@query
def w3_txids_in_order(L: Ledger) -> DataFrame:
    return lookups.txids_in_order(L.blocks, L.tx).orderBy("height", "blockindex")


@query
def w4_gaps(L: Ledger) -> DataFrame:
    return chain.gaps(L.arrivals)


@query
def w5_time_order(L: Ledger) -> DataFrame:
    return chain.blocks_in_time_order(L.arrivals.unionByName(L.arrivals)).select("hash", "position")


@query
def w6_truncate(L: Ledger) -> DataFrame:
    target = L.blocks.filter("height = 1500").select("hash")
    return chain.truncate_at(L.blocks, target).select("height", "hash")


@query
def w7_heights(L: Ledger) -> DataFrame:
    return j15_chain_linkage(L).filter("state = 'linked'").select("hash", "height")


@query
def w8_renumber(L: Ledger) -> DataFrame:
    out = None
    for name, df in (("blocks", L.blocks), ("tx", L.tx), ("utxo", L.utxo)):
        shifted = chain.renumber_heights(df, 5000, 1200)
        part = shifted.select(F.lit(name).alias("source"), "hash", F.col("height").cast("long").alias("height"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def w9_last_block(L: Ledger) -> DataFrame:
    return chain.last_block(L.blocks).select("*", hashing.header_hex().alias("block"))


# Lookups


def _customers(L: Ledger) -> DataFrame:
    """Customers by the key hash that their address decodes to, or the reason why it has none."""

    def resolve(ledger: Ledger) -> DataFrame:
        found = scripts.address_to_pubkeyhash(feeds.customer_addresses(ledger))
        return materialize(found.select("c_custkey", "pubkeyhash", F.col("reason").alias("failed")), "customers")

    return _once(L, "customers", resolve)


@query
def q1_utxo_by_address(L: Ledger) -> DataFrame:
    asked = _customers(L)
    good, bad = asked.filter("failed IS NULL"), asked.filter("failed IS NOT NULL").drop("pubkeyhash")
    found = utxo.utxo_by_pubkeyhash(good, L.utxo).drop("pubkeyhash")
    return found.unionByName(bad, allowMissingColumns=True)


@query
def q2_balance_by_address(L: Ledger) -> DataFrame:
    asked = _customers(L)
    good, bad = asked.filter("failed IS NULL"), asked.filter("failed IS NOT NULL").drop("pubkeyhash")
    found = utxo.balance_by_pubkeyhash(good, L.utxo, L.blocks).join(good, "pubkeyhash").drop("pubkeyhash")
    return found.unionByName(bad, allowMissingColumns=True)


@query
def q3_utxo_by_tx(L: Ledger) -> DataFrame:
    return _ask_utxo(L, feeds.keys(L), utxo.utxo_by_tx)


@query
def q4_outpoint_unspent(L: Ledger) -> DataFrame:
    named = L.inputs.select(F.col("prev_hash").alias("hash"), F.col("prev_index").alias("pos"))
    return _ask_utxo(L, L.outputs.select("hash", "pos").unionByName(named), utxo.outpoint_unspent)


@query
def q5_block_at_height(L: Ledger) -> DataFrame:
    asked = L.blocks.select("height").unionByName(L.blocks.select((-F.col("height")).alias("height")))
    return _listing(L, asked, "height")


@query
def q6_block_at_hash(L: Ledger) -> DataFrame:
    unknown = L.blocks.select(tagged_hash("no:", F.col("height")).alias("hash"))
    return _listing(L, L.blocks.select("hash").unionByName(unknown), "hash")


@query
def q7_tx_entry(L: Ledger) -> DataFrame:
    return lookups.tx_entries(feeds.keys(L), *L.wire_tables(), L.tx, L.utxo)


@query
def q8_tx_hex(L: Ledger) -> DataFrame:
    path, pieces = _once(L, "block_file", feeds.block_file)
    return lookups.tx_hex(feeds.keys(L), L.tx, blockfile.tx_index(pieces), lambda k: blockfile.fetch_blocks(k, path))


def _collection_text(L: Ledger) -> DataFrame:
    return _texts_of(L, L.collection)


def _texts_of(L: Ledger, held: DataFrame) -> DataFrame:
    """``held`` with its transactions as hex: they are joined as bytes and by order keys, hash and text are made behind that."""
    whole = codec.whole_transactions(L.raw.withColumn("hash", F.col("okey"))).withColumnRenamed("hash", "okey")
    joined = held.drop("hash").join(whole, "okey")
    rest = [c for c in held.columns if c not in ("hash", "okey")]
    return joined.select(tx_hash(F.col("okey")).alias("hash"), *rest, hashing.to_hex(F.col("raw")).alias("tx"))


@query
def q9_tx_from_collection(L: Ledger) -> DataFrame:
    return lookups.collection_entries(feeds.keys(L), _collection_text(L), L.utxo)


@query
def q10_hex_from_collection(L: Ledger) -> DataFrame:
    keys = _asked(L)
    return lookups.hex_from_collection(keys, _stored(L, "collection").near(keys, "hash"))


def _proofs(L: Ledger) -> DataFrame:
    keys = _asked(L)
    placed, blocks = _placed(L, keys, unique=True)
    return merkle.merkle_proofs(keys, placed, blocks, _trees(L))


@query
def q11_merkle_proof(L: Ledger) -> DataFrame:
    steps = F.transform("branches", lambda b: F.concat_ws(":", b["hash"], b["pos"]))
    return _proofs(L).withColumn("branches", F.array_join(steps, ","))


@query
def q12_verify_proof(L: Ledger) -> DataFrame:
    found = _proofs(L).filter("found")
    return merkle.verify_merkle_proofs(found).select("tx_hash", "verified")


@query
def q13_collections_list(L: Ledger) -> DataFrame:
    return _monitor_list(L).filter("stage < 2").select("stage", "position", "name").orderBy("stage", "position")


@query
def q14_collection_contents(L: Ledger) -> DataFrame:
    return L.collection.select("name", "hash")


@query
def q15_mempool_list(L: Ledger) -> DataFrame:
    return L.mempool.select(*display.mempool_record())


@query
def q16_peers_list(L: Ledger) -> DataFrame:
    names = F.array_join(display.decode_services(F.col("services")), ",")
    return _addr(L).withColumn("service_names", names)


@query
def q17_zero_offset_blocks(L: Ledger) -> DataFrame:
    return L.blocks.filter("offset = 0").select("hash")


@query
def u1_known_txs(L: Ledger) -> DataFrame:
    return lookups.known_txs(L.tx, L.mempool, L.collection)


@query
def u2_monitor_union(L: Ledger) -> DataFrame:
    return _monitor_list(L).select("stage", "position", "name")


# Streams


@query
def t1_loose_ingest(L: Ledger) -> DataFrame:
    return _ingested(L).mempool()


@query
def t2_block_ingest(L: Ledger) -> DataFrame:
    return _ingested(L).utxo()


@query
def t3_block_buffer(L: Ledger) -> DataFrame:
    log = _ingested(L)
    last = log.last_batch()
    nowhere = F.lit(None).cast("long").alias("height")
    linked = log.read("blocks").select("hash", "height", F.lit("linked").alias("state"))
    pending = log.read_batch("pending", last).select("hash", nowhere, F.lit("pending").alias("state"))
    rejected = log.read("rejected").select("hash", nowhere, F.lit("rejected").alias("state")).distinct()
    return linked.unionByName(pending).unionByName(rejected)


@query
def t4_duplicate_blocks(L: Ledger) -> DataFrame:
    """Every header was announced twice; each block is stored once."""
    return _ingested(L).read("blocks").groupBy("hash").agg(F.count(F.lit(1)).alias("times"))


@query
def t5_orphan_signals(L: Ledger) -> DataFrame:
    return chain.orphan_signals(L.arrivals, _late_blocks(L), 10).select("hash", "height", "timestamp")


@query
def t6_roll_back(L: Ledger) -> DataFrame:
    blocks, tx, unspent, orphan = chain.roll_back_tip(L.blocks, L.tx, L.utxo)
    out = None
    for name, df in (("blocks", blocks), ("tx", tx), ("utxo", unspent), ("orphan", orphan)):
        part = df.select(F.lit(name).alias("source"), "hash", F.col("height").cast("long").alias("height"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def t6_stream_roll_back(L: Ledger) -> DataFrame:
    """A late block takes the tip off within the stream."""
    log = feeds.run_late_block(L, _ingested(L))
    out = None
    for name, df in (("blocks", log.read("blocks")), ("tx", log.read("tx")), ("utxo", log.utxo()), ("orphan", log.read("orphans"))):
        part = df.select(F.lit(name).alias("source"), "hash", F.col("height").cast("long").alias("height"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def a1_stream_balance(L: Ledger) -> DataFrame:
    """Balances that the stream keeps, after a late block took the tip off."""
    return feeds.run_late_block(L, _ingested(L), True).balances()


@query
def t7_monitor_intervals(L: Ledger) -> DataFrame:
    """One monitor is added at the cut, another is deleted then."""
    at = (CUT // 86400) << 40
    added = replace(MONITORS[0], valid_from=at)
    deleted = replace(MONITORS[2], valid_to=at)
    return monitors.own_matches(L.outputs, [added, deleted])


@query
def t7_stream_monitors(L: Ledger) -> DataFrame:
    """The same as events of the feed, with a restart in between."""
    return feeds.run_monitor_changes(L, (CUT // 86400) << 40).read("collection")


@query
def t8_broadcast_capture(L: Ledger) -> DataFrame:
    captured = monitors.capture(L.txs, L.assigned, MONITORS)
    return captured.filter(F.col("name") == monitors.BROADCAST).select("hash")


@query
def t8_stream_collections(L: Ledger) -> DataFrame:
    return _ingested(L).read("collection")


@query
def t9_broadcast_admission(L: Ledger) -> DataFrame:
    """All transactions are sent in twice, some of them without the last byte.

    Known are the confirmed, the captured and the older loose ones.
    """
    whole = codec.whole_transactions(L.raw.withColumn("hash", F.col("okey"))).withColumnRenamed("hash", "okey")
    text = whole.join(L.txs.select("okey", "submitted"), "okey").withColumn("tx", hashing.to_hex(F.col("raw")))
    cut = F.when(F.col("submitted"), F.expr("substr(tx, 1, length(tx) - 2)")).otherwise(F.col("tx"))
    # Hashes are made behind the joins; in the turn they stand as bytes, which have the order of their digits.
    digits = F.unhex(tx_hash(F.col("okey")))
    twice = text.select("okey", cut.alias("tx"), digits.alias("digits"), F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    twice = twice.select("okey", "tx", F.struct("again", "digits").alias("turn"))
    stored = lookups.known_txs(L.tx, _old(L.mempool), L.collection)
    # The long expression of a txid is not packed as well, which would work it out several times.
    named = codec.txids(L.raw).withColumn("hash", hashing.packed(F.col("hash")))
    known = named.join(hashing.short(stored), "hash", "left_semi").select(F.col("txid").alias("hash"))
    judged = lookups.admit_broadcasts(twice, known, 300, "turn")
    return judged.select(tx_hash(F.col("okey")).alias("hash"), F.col("turn.again").alias("again"), "txid", "accepted", "reason")


def _rebuilt(L: Ledger, rules: list[monitors.Monitor]) -> dict[str, DataFrame]:
    """The tables of the blocks alone, from the raw block file.

    The view names blocks and transactions by other hashes than their bytes
    have, so the names are put back after decoding.
    """
    path, index = _block_file(L)
    found = blockfile.read_block_txs(index, path)
    names = L.blocks.select(F.col("nonce"), F.col("hash").alias("block_hash"), "height")
    hashes = L.tx.select("hash", "height", "blockindex")
    named = found.join(names, "nonce").join(hashes, ["height", "blockindex"])
    decoded = codec.decode_tx_table(
        named.select("block_hash", "hash", "blockindex", F.col("tx_size").alias("txsize"), F.col("raw_tx").alias("raw"))
    )
    decoded = materialize(decoded, "decoded")
    inputs = decoded.select("block_hash", "hash", "blockindex", F.explode("vin").alias("e")).select(
        "block_hash", "hash", "blockindex", "e.prev_hash", "e.prev_index"
    )
    outputs = decoded.select("block_hash", "hash", "blockindex", F.posexplode("vout").alias("pos", "e")).select(
        "block_hash",
        "hash",
        F.col("pos").cast("long").alias("pos"),
        F.col("e.value").alias("satoshis"),
        hashing.to_hex(F.col("e.script")).alias("script_hex"),
    )
    txs = decoded.select("block_hash", "hash", "blockindex", "txsize")
    arrived = L.arrivals.join(L.blocks.select("hash"), "hash", "left_semi")
    return rebuild(arrived, txs, inputs, outputs, START_HASH, START_HEIGHT, rules)


@query
def t10_rebuild(L: Ledger) -> DataFrame:
    return _rebuilt(L, [])["utxo"]


@query
def t10_rebuild_collections(L: Ledger) -> DataFrame:
    return _rebuilt(L, MONITORS)["collection"]


def _requests(events: DataFrame) -> DataFrame:
    client = throttle.client_key(F.lit(None).cast("string"), F.col("user_id").cast("string"))
    at = display.utc_to_micros(F.col("ts"))
    return events.select(client.alias("client"), at.alias("t"), F.col("event_id").alias("id"))


@query
def t11_throttle(L: Ledger) -> DataFrame:
    return throttle.throttle(_requests(L.source("events")), 2, 86_400_000_000).drop("t")


@query
def t12_peer_log(L: Ledger) -> DataFrame:
    def rows(df: DataFrame) -> DataFrame:
        return _connections(df.withColumnRenamed("event_type", "kind"))

    return _routed(L, "peer-log", ["Connected", "Disconnected"], rows)


@query
def t13_inventory_split(L: Ledger) -> DataFrame:
    txs, blocks = event_stream.split_inventory(feeds.peers(L))
    return txs.select("event_id", F.lit("tx").alias("wants")).unionByName(
        blocks.select("event_id", F.lit("block").alias("wants"))
    )


def balance_report(spark: SparkSession, folder: str) -> DataFrame:
    """Confirmed and unconfirmed balance of every owner, largest first."""
    ledger = Ledger.of(spark, folder)
    owned = utxo.known_owners(utxo.utxo_set(ledger.outputs, ledger.inputs))
    sums = utxo.balances(owned, utxo.tip_height(ledger.blocks))
    names = ledger.source("customer").select("c_name", pubkeyhash_of(F.col("c_custkey")).alias("pubkeyhash"))
    return sums.join(names, "pubkeyhash", "left").orderBy(F.desc("confirmed"), "pubkeyhash")
