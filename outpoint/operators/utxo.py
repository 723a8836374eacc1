"""The unspent-output set and everything read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import restored, short
from ..functions.scripts import UNKNOWN, is_spendable, script_to_pubkeyhash
from ..session import materialize
from .maintenance import matching

# Fixed values.
NOT_IN_BLOCK = -1
COMPLETE = 6


def spent_outpoints(inputs: DataFrame) -> DataFrame:
    """Distinct outpoints spent by inputs that are not in a coinbase.

    Distinct first: many inputs may name one outpoint, and the partial
    aggregation removes them before the shuffle.
    """
    spending = inputs.filter(F.coalesce(F.col("blockindex") != 0, F.lit(True)))
    return spending.select(F.col("prev_hash").alias("hash"), F.col("prev_index").alias("pos")).distinct()


def created_outputs(outputs: DataFrame) -> DataFrame:
    """utxo rows of all spendable outputs, spent or not."""
    return outputs.filter(is_spendable(F.col("script_hex"))).select(
        "hash",
        "pos",
        "satoshis",
        F.col("height").cast("int").alias("height"),
        script_to_pubkeyhash(F.col("script_hex")).alias("pubkeyhash"),
    )


def utxo_set(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    return created_outputs(outputs).join(spent_outpoints(inputs), ["hash", "pos"], "left_anti")


def upsert(current: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the newest row of each key in ``delta`` in place of its own.

    Only ``delta`` is aggregated. The stored rows go through one anti join,
    without a shuffle of their own when the delta is small enough to broadcast.
    """
    columns = current.columns
    rest = [c for c in columns if c not in keys]
    newest = delta.groupBy(*keys).agg(F.max(F.struct(F.col(order), *rest)).alias("newest"))
    written = newest.select(*[c if c in keys else F.col(f"newest.{c}").alias(c) for c in columns])
    return current.join(written.select(*keys), keys, "left_anti").select(*columns).unionByName(written)


def balances(utxo: DataFrame, tip: Column, complete: int = COMPLETE, by: str = "pubkeyhash") -> DataFrame:
    """Confirmed and unconfirmed satoshis per key hash, given the tip height."""
    settled = (F.col("height") >= 0) & (F.col("height") <= tip - complete)
    zero = F.lit(0).cast("long")
    return utxo.groupBy(by).agg(
        F.sum(F.when(settled, F.col("satoshis")).otherwise(zero)).alias("confirmed"),
        F.sum(F.when(settled, zero).otherwise(F.col("satoshis"))).alias("unconfirmed"),
    )


def known_owners(utxo: DataFrame) -> DataFrame:
    """Rows with a key hash; the others share one literal and never match."""
    return utxo.filter(F.col("pubkeyhash") != UNKNOWN)


def tip_height(blocks: DataFrame) -> Column:
    """Height of the tip as a scalar subquery, 0 without blocks."""
    return blocks.agg(F.coalesce(F.max("height"), F.lit(0))).scalar()


def balance_by_pubkeyhash(keys: DataFrame, utxo: DataFrame, blocks: DataFrame, complete: int = COMPLETE) -> DataFrame:
    """Balance of each requested key hash; 0/0 when it owns nothing."""
    wanted = keys.select("pubkeyhash").distinct()
    # Sums come first, so an owner of many outputs is one row when it meets its key.
    sums = balances(known_owners(utxo), tip_height(blocks), complete)
    zero = F.lit(0).cast("long")
    return wanted.join(sums, "pubkeyhash", "left").select(
        "pubkeyhash",
        F.coalesce("confirmed", zero).alias("confirmed"),
        F.coalesce("unconfirmed", zero).alias("unconfirmed"),
    )


def utxo_by_pubkeyhash(keys: DataFrame, utxo: DataFrame) -> DataFrame:
    """Unspent outputs of each key hash, with all columns of ``keys``.

    The distinct keys are written first: both sides of the join are then plain
    shuffles, and Spark splits an owner that has most of the outputs.
    """
    owned = known_owners(utxo).select(
        "pubkeyhash",
        "height",
        F.col("pos").alias("tx_pos"),
        F.col("hash").alias("tx_hash"),
        F.col("satoshis").alias("value"),
    )
    return owned.join(materialize(keys.distinct(), "owners"), "pubkeyhash")


def utxo_by_tx(keys: DataFrame, utxo: DataFrame) -> DataFrame:
    wanted = materialize(keys.select("hash").distinct(), "asked")
    return utxo.join(wanted, "hash").select("hash", "pos", F.col("satoshis").alias("satoshi"), "height")


def outpoint_unspent(outpoints: DataFrame, utxo: DataFrame) -> DataFrame:
    """Whether each distinct outpoint is in the unspent set.

    Outpoints with a null are in no table. Apart from them the keys have one
    and the same plan in both joins, so they are shuffled once, as bytes.
    """
    key = ["hash", "pos"]
    asked = short(outpoints.select(*key))
    known = F.col("hash").isNotNull() & F.col("pos").isNotNull()
    wanted, nameless = asked.filter(known).distinct(), asked.filter(~known).distinct()
    present = matching(short(utxo.select(*key)), wanted, key).withColumn("unspent", F.lit(True))
    answers = wanted.join(present, key, "left").unionByName(nameless, allowMissingColumns=True)
    return restored(answers.select(*key, F.coalesce("unspent", F.lit(False)).alias("unspent")), outpoints)


def spent_flags(outputs: DataFrame, utxo: DataFrame) -> DataFrame:
    """Outputs with ``spent`` and ``spendable``; unspendable ones read as spent."""
    present = utxo.select("hash", "pos").withColumn("_unspent", F.lit(True))
    return outputs.join(present, ["hash", "pos"], "left").select(
        *outputs.columns,
        F.col("_unspent").isNull().alias("spent"),
        is_spendable(F.col("script_hex")).alias("spendable"),
    )


def fees(txs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Fee per transaction with inputs, as seen when it arrived.

    ``seq`` is the arrival order in ``txs``, ``inputs`` and ``outputs``. An
    input is funded when a spendable output with its outpoint arrived before
    and nothing spent it before. The fee is 0 if any input is not funded.

    Only the first spender of an outpoint can be funded, so outpoints are
    reduced to that spender before the join. Both of its sides then have one
    row per outpoint, however many inputs name the same one.

    A coinbase (``blockindex`` 0, if ``inputs`` has it) spends nothing: it
    takes no output from a later spender, but sees one that is still unspent.
    """
    coinbase = F.col("blockindex") == 0 if "blockindex" in inputs.columns else F.lit(False)
    marked = inputs.withColumn("_coinbase", F.coalesce(coinbase, F.lit(False)))
    spending = marked.groupBy("prev_hash", "prev_index", "seq", "hash", "_coinbase").agg(F.count(F.lit(1)).alias("k"))
    by_outpoint = spending.filter("NOT _coinbase").groupBy("prev_hash", "prev_index")
    first = by_outpoint.agg(F.min(F.struct("seq", "hash", "k")).alias("first"))
    # One transaction per block: their few outpoints are written, and only the spenders of these are looked at again.
    outpoint = ["prev_hash", "prev_index"]
    named = marked.filter("_coinbase").select(F.col("prev_hash").alias("spent"), F.col("prev_index").alias("pos"))
    asked = materialize(named.distinct(), "coinbase-outpoints").toDF(*outpoint)
    taken = matching(marked.filter("NOT _coinbase").select(*outpoint, "seq"), asked, outpoint).groupBy(*outpoint)
    taken = taken.agg(F.min(F.struct("seq")).alias("_first")).select(*outpoint, F.col("_first.seq").alias("_taken"))
    seen = spending.filter("_coinbase").join(taken, outpoint, "left")
    seen = seen.filter(F.coalesce(F.col("_taken") > F.col("seq"), F.lit(True)))
    first = first.unionByName(seen.select("prev_hash", "prev_index", F.struct("seq", "hash", "k").alias("first")))
    known = outputs.filter(is_spendable(F.col("script_hex"))).select(
        F.col("hash").alias("prev_hash"),
        F.col("pos").alias("prev_index"),
        F.col("seq").alias("made_seq"),
        "satoshis",
    )
    funded = (
        first.join(known, ["prev_hash", "prev_index"])
        .filter(F.col("made_seq") < F.col("first.seq"))
        .groupBy(F.col("first.hash").alias("hash"))
        .agg(F.sum(F.col("first.k") * F.col("satoshis")).alias("paid"), F.sum("first.k").alias("funded"))
    )
    needed = inputs.groupBy("hash").agg(F.count(F.lit(1)).alias("needed"))
    made = outputs.groupBy("hash").agg(F.sum("satoshis").alias("made"))
    zero = F.lit(0).cast("long")
    left_over = F.greatest(zero, F.col("paid") - F.coalesce("made", zero))
    return (
        txs.select("hash")
        .join(needed, "hash")
        .join(funded, "hash", "left")
        .join(made, "hash", "left")
        .select("hash", F.when(F.col("funded") == F.col("needed"), left_over).otherwise(zero).alias("fee"))
    )


def tx_summary(raw: DataFrame, outputs: DataFrame) -> DataFrame:
    """(hash, txsize, satoshis) from serialized chunks and outputs.

    A negative output sum is out of range, and its transaction is left out.
    """
    sizes = raw.groupBy("hash").agg(F.sum(F.length("raw")).alias("txsize"))
    made = outputs.groupBy("hash").agg(F.sum("satoshis").alias("satoshis"))
    total = F.coalesce("satoshis", F.lit(0).cast("long"))
    return sizes.join(made, "hash", "left").withColumn("satoshis", total).filter("satoshis >= 0")


def block_summary(pieces: DataFrame) -> DataFrame:
    """(height, blocksize, numtxs) from the pieces of serialized blocks."""
    starts = (F.col("blockindex") >= 0) & (F.col("chunk") == 0)
    return pieces.groupBy("height").agg(
        F.sum(F.length("data")).alias("blocksize"), F.count(F.when(starts, 1)).alias("numtxs")
    )
