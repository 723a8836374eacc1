"""Bulk lookups: a frame of keys in, a frame of answers out.

Large tables are cut down to the requested keys by a semi join before anything
else, so a short list of keys is broadcast and nothing large is shuffled.

Lists whose length has no bound, such as the transactions of a block, are
answered in long form, one row per element with its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, display, hashing, validate
from ..session import materialize
from .maintenance import matching
from .utxo import spent_flags

LATEST_BLOCKS = 20


def with_elements(rows: DataFrame, elements: DataFrame, on: str, owners: DataFrame | None = None) -> DataFrame:
    """Left join of unique ``rows`` with any number of ``elements`` each.

    Written as an inner join and the rows without elements: an inner join is
    split by AQE when one row has a large part of the elements, while the
    right side of an outer join is not. ``owners`` has the keys that have
    elements, where they are known without working the elements out.
    """
    owners = elements if owners is None else owners
    without = rows.join(owners.select(on).distinct(), on, "left_anti")
    return rows.join(elements, on).unionByName(without, allowMissingColumns=True)


def known_txs(tx: DataFrame | None, mempool: DataFrame, collection: DataFrame) -> DataFrame:
    """All hashes in any of the tables, with repeats; ``tx`` may be absent."""
    parts = mempool.select("hash").unionByName(collection.select("hash"))
    return parts if tx is None else tx.select("hash").unionByName(parts)


def _asked(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct hashes of ``keys`` as bytes: the known ones, and a null if there is one.

    A null is in no table. Apart from it the keys have one and the same plan
    in every join, so they are shuffled once.
    """
    short = hashing.short(keys.select("hash"))
    return short.filter("hash IS NOT NULL").distinct(), short.filter("hash IS NULL").distinct()


def tx_exists(keys: DataFrame, tx: DataFrame | None, mempool: DataFrame, collection: DataFrame) -> DataFrame:
    wanted, nameless = _asked(keys)
    found = matching(hashing.short(known_txs(tx, mempool, collection)), wanted, ["hash"])
    known = found.distinct().withColumn("_known", F.lit(True))
    answers = wanted.join(known, "hash", "left").unionByName(nameless, allowMissingColumns=True)
    return hashing.restored(answers.select("hash", F.coalesce("_known", F.lit(False)).alias("known")), keys)


def tx_block_offset(keys: DataFrame, tx: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where the block that holds a transaction starts."""
    wanted = keys.select("hash").distinct()
    placed = matching(tx.select("hash", "height"), wanted, ["hash"])
    return placed.join(blocks.select("height", "offset"), "height").select("hash", "offset")


def tx_block(keys: DataFrame, tx: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block of each confirmed transaction."""
    wanted = keys.select("hash").distinct()
    placed = matching(tx.select("hash", "height"), wanted, ["hash"])
    heads = blocks.select("height", F.col("hash").alias("block_hash"), "merkle_root")
    return placed.join(heads, "height").select("hash", "height", "block_hash", "merkle_root")


def tx_position(keys: DataFrame, tx: DataFrame) -> DataFrame:
    wanted = keys.select("hash").distinct()
    places = matching(tx.select("hash", "height", "blockindex"), wanted, ["hash"])
    return wanted.join(places, "hash", "left")


def latest_blocks(blocks: DataFrame, n: int = LATEST_BLOCKS) -> DataFrame:
    return blocks.orderBy(F.desc("height")).limit(n).select(*display.block_record())


def txids_in_order(blocks: DataFrame, tx: DataFrame) -> DataFrame:
    """(height, blockindex, txid) of the given blocks."""
    wanted = blocks.select("height").distinct()
    return tx.join(wanted, "height", "left_semi").select("height", "blockindex", F.col("hash").alias("txid"))


def block_listing(keys: DataFrame, blocks: DataFrame, tx: DataFrame, on: str) -> DataFrame:
    """Display record and transactions of the blocks at ``keys`` (column ``on``).

    One row per transaction; a block without any has one row, and so has an
    unknown key, with a message in ``not_found``.
    """
    wanted = keys.select(F.col(on).alias("key")).distinct()
    records = blocks.select(F.col(on).alias("key"), *display.block_record())
    txids = tx.select("height", "blockindex", F.col("hash").alias("txid"))
    missing = F.concat(F.lit(f"block {on} "), F.col("key").cast("string"), F.lit(" not found"))
    found = with_elements(wanted.join(records, "key"), txids, "height")
    absent = wanted.join(records, "key", "left_anti").withColumn("not_found", missing)
    return found.unionByName(absent, allowMissingColumns=True)


def block_summary_records(blocks: DataFrame, tx: DataFrame) -> DataFrame:
    """Header display fields of each block with its transactions in long form."""
    records = blocks.select(*display.block_record()).drop("blocksize", "numtxs")
    txids = tx.select("height", "blockindex", F.col("hash").alias("txid"))
    return with_elements(records, txids, "height")


def status(blocks: DataFrame, tx: DataFrame | None, utxo: DataFrame | None, mempool: DataFrame | None) -> DataFrame:
    """One row: tip height, its time and the table sizes; an absent table counts 0."""

    def size(df: DataFrame | None, name: str) -> Column:
        rows = F.lit(0).cast("long") if df is None else df.agg(F.count(F.lit(1))).scalar()
        return rows.alias(name)

    newest = display.timestamp_as_string(F.max_by("timestamp", "height"))
    tip = blocks.agg(
        F.coalesce(newest, F.lit("unknown")).alias("last_block_time"),
        F.coalesce(F.max("height"), F.lit(0)).cast("long").alias("block_height"),
    )
    return tip.select(
        "*", size(tx, "number_of_txs"), size(utxo, "number_of_utxo"), size(mempool, "number_of_mempool")
    )


def tx_elements(inputs: DataFrame, outputs: DataFrame, utxo: DataFrame) -> DataFrame:
    """Inputs and outputs of transactions as one long list.

    hash, side (``in`` or ``out``), n, script_hex; prev_hash, prev_index and
    sequence of inputs; satoshis and ``spent`` of outputs.
    """
    spending = inputs.select(
        "hash",
        F.lit("in").alias("side"),
        F.col("vin").cast("long").alias("n"),
        F.col("script_sig_hex").alias("script_hex"),
        "prev_hash",
        "prev_index",
        "sequence",
    )
    flagged = spent_flags(outputs.select("hash", "pos", "satoshis", "script_hex"), utxo).select(
        "hash", F.lit("out").alias("side"), F.col("pos").cast("long").alias("n"), "script_hex", "satoshis", "spent"
    )
    return spending.unionByName(flagged, allowMissingColumns=True)


def tx_entries(
    keys: DataFrame, heads: DataFrame, inputs: DataFrame, outputs: DataFrame, tx: DataFrame, utxo: DataFrame
) -> DataFrame:
    """Each transaction whole: place, version, locktime and all elements.

    ``heads`` has hash, version and locktime. One row per input and output (see
    ``tx_elements``); a transaction in no block has one row with a message in
    ``not_found``.
    """
    wanted = materialize(keys.select("hash").distinct(), "asked")
    placed = materialize(tx_position(wanted, tx), "placed")
    inside = placed.filter("height is not null")
    asked = [matching(df, inside.select("hash"), ["hash"]) for df in (heads, inputs, outputs, utxo)]
    missing = F.concat(F.lit("Transaction "), F.col("hash"), F.lit(" not found in block"))
    confirmed = inside.join(asked[0].select("hash", "version", "locktime"), "hash")
    owners = asked[1].select("hash").unionByName(asked[2].select("hash"))
    confirmed = with_elements(confirmed, tx_elements(*asked[1:]), "hash", owners)
    absent = placed.filter("height is null").select("hash", missing.alias("not_found"))
    return confirmed.unionByName(absent, allowMissingColumns=True)


def collection_entries(keys: DataFrame, collection: DataFrame, utxo: DataFrame) -> DataFrame:
    """Each captured transaction whole, decoded from its stored text (hash, tx).

    One row per input and output (see ``tx_elements``) with version and
    locktime; an unknown hash has one row with a message in ``failed``.

    A transaction meets the positions of its unspent outputs as one row, before
    it is decoded: its elements are never shuffled, and its text only once.
    """
    wanted, nameless = _asked(keys)
    held = matching(hashing.short(collection), wanted, ["hash"])
    texts = held.groupBy("hash").agg(F.min(hashing.unpacked(F.col("tx"))).alias("tx"))
    left = matching(hashing.short(utxo.select("hash", "pos")), wanted, ["hash"])
    left = left.groupBy("hash").agg(F.collect_list(F.col("pos").cast("long")).alias("unspent"))
    asked = wanted.join(texts, "hash", "left").join(left, "hash", "left").unionByName(nameless, allowMissingColumns=True)
    asked = asked.select(hashing.unpacked(F.col("hash")).alias("hash"), F.unhex("tx").alias("raw"), "unspent")
    decoded = codec.decode_tx_table(asked, unspent="unspent")
    long, text = [F.lit(None).cast(kind) for kind in ("long", "string")]

    def spending(e: Column, n: Column) -> Column:
        named = [e["script_sig"].alias("script"), e["prev_hash"].alias("prev_hash"), e["prev_index"].alias("prev_index")]
        rest = [e["sequence"].alias("sequence"), long.alias("satoshis"), F.lit(None).cast("boolean").alias("spent")]
        return F.struct(F.lit("in").alias("side"), n.cast("long").alias("n"), *named, *rest)

    def made(e: Column, n: Column) -> Column:
        named = [e["script"].alias("script"), text.alias("prev_hash"), long.alias("prev_index"), long.alias("sequence")]
        rest = [e["value"].alias("satoshis"), (e["unspent"] == 0).alias("spent")]
        one = F.struct(F.lit("out").alias("side"), n.cast("long").alias("n"), *named, *rest)
        # An outpoint that is several times in the unspent set is as many rows, as in a join.
        return F.array_repeat(one, F.greatest(F.lit(1), e["unspent"].cast("int")))

    elements = F.concat(F.transform("vin", spending), F.flatten(F.transform("vout", made)))
    message = F.when(F.col("version").isNull(), F.concat(F.lit("Unknown txid "), F.col("hash")))
    return decoded.select("hash", "version", "locktime", message.alias("failed"), F.explode_outer(elements).alias("e")).select(
        "hash",
        "version",
        "locktime",
        "e.side",
        "e.n",
        hashing.to_hex(F.col("e.script")).alias("script_hex"),
        "e.prev_hash",
        "e.prev_index",
        "e.sequence",
        "e.satoshis",
        "e.spent",
        "failed",
    )


def hex_from_collection(keys: DataFrame, collection: DataFrame) -> DataFrame:
    """Stored text of each transaction; copies in several collections are equal."""
    wanted, nameless = _asked(keys)
    held = matching(hashing.short(collection), wanted, ["hash"])
    texts = held.groupBy("hash").agg(F.min(hashing.unpacked(F.col("tx"))).alias("tx"))
    missing = F.concat(F.lit("Unknown txid "), F.col("hash"))
    answers = wanted.join(texts, "hash", "left").unionByName(nameless, allowMissingColumns=True)
    answers = hashing.restored(answers, keys.select("hash"))
    return answers.withColumn("failed", F.when(F.col("tx").isNull(), missing))


def tx_hex(keys: DataFrame, tx: DataFrame, index: DataFrame, fetch) -> DataFrame:
    """Serialized transactions by hash, read from the block file.

    ``index`` has the byte range of each (height, blockindex), ``fetch`` reads
    ranges and keeps their other columns, so the bytes are joined to nothing.
    A transaction in no block has a message in ``not_found``.
    """
    placed = materialize(tx_position(keys, tx), "placed")
    located = placed.filter("height IS NOT NULL").join(index, ["height", "blockindex"])
    found = fetch(located.select("hash", "offset", "size")).select("hash", hashing.to_hex(F.col("raw")).alias("tx"))
    missing = F.concat(F.lit("Transaction "), F.col("hash"), F.lit(" not found in block"))
    absent = placed.filter("height IS NULL").select("hash", missing.alias("not_found"))
    return found.unionByName(absent, allowMissingColumns=True)


def admit_broadcasts(
    submitted: DataFrame, known: DataFrame, max_bytes: int = validate.MAX_TX_BYTES, arrival: str | None = None
) -> DataFrame:
    """Rows of ``submitted`` with txid, accepted and reason instead of ``tx``.

    ``tx`` is the serialized transaction as hex; bytes behind its end are not
    part of it. ``known`` has the hashes that exist already (``known_txs``).
    Of one transaction submitted several times, also under several names, the
    first in ``arrival`` order is taken, the others exist by then. ``arrival``
    is a unique column, which may be a struct; any one is taken without it.
    """
    kept = [c for c in submitted.columns if c != "tx"]
    checked = submitted.withColumn("_reason", validate.check_tx_hex(F.col("tx"), max_bytes)["reason"])
    turn = "_turn" if arrival is None else arrival
    carried = kept if arrival in kept else [*kept, turn]
    checked = checked.withColumn("_turn", F.monotonically_increasing_id()) if arrival is None else checked
    raw = F.when(F.col("_reason").isNull(), F.unhex("tx"))
    decoded = codec.decode_tx_table(checked.select(*carried, "_reason", raw.alias("_bytes"), raw.alias("raw")))
    own = F.expr("substring(_bytes, 1, int(size))")
    named = decoded.select(
        *carried,
        F.when(F.col("size").isNotNull(), hashing.txid(own)).alias("txid"),
        F.coalesce("_reason", F.when(F.col("size").isNull(), "not a transaction")).alias("_reason"),
    )
    texts = named
    named = materialize(hashing.short(named), "submitted")
    # Bytes that are packed do not have the order of their texts.
    order = hashing.unpacked(F.col(turn)) if turn in hashing.text_columns(texts) else F.col(turn)
    first = named.filter("_reason IS NULL").groupBy("txid").agg(F.min(order).alias("_first"))
    first = materialize(first, "first-submitted")
    seen = matching(hashing.short(known.select(F.col("hash").alias("txid"))), first, ["txid"])
    seen = first.join(seen.distinct().withColumn("_known", F.lit(True)), "txid", "left")
    judged = hashing.restored(named.join(seen, "txid", "left"), texts)
    late = F.coalesce("_known", F.lit(False)) | (F.col(turn) > F.col("_first"))
    exists = F.when(late, F.concat(F.lit("already exists: "), F.col("txid")))
    reason = F.coalesce("_reason", exists)
    return judged.select(*kept, "txid", reason.isNull().alias("accepted"), reason.alias("reason"))


def inventory_counts(objects: DataFrame, by: list[str], code: Column) -> DataFrame:
    """Number of inventory objects of each type."""
    return objects.groupBy(*by, display.inv_type_name(code).alias("type")).agg(F.count(F.lit(1)).alias("n"))
