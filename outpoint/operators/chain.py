"""The block chain: linkage, heights, gaps, truncation, orphans and roll-back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import timestamp_age_sec
from ..session import materialize
from .maintenance import drop_known
from .ordering import previous_value, row_position

# Fixed values.
CAUGHT_UP_SEC = 600

# Pointer moves per round: fewer rounds to write, for more joins in each.
HOPS = 3


def first_arrivals(arrivals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per hash, the first to arrive; hashes in ``known`` are dropped."""
    rest = [c for c in arrivals.columns if c not in ("hash", "arrival")]
    first = arrivals.groupBy("hash").agg(F.min(F.struct("arrival", *rest)).alias("first"))
    rows = first.select(*[c if c == "hash" else F.col(f"first.{c}").alias(c) for c in arrivals.columns])
    return rows if known is None else drop_known(rows, known, ["hash"])


def eldest_children(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): of the children of one parent the first to arrive is kept."""
    first = blocks.groupBy("prev_hash").agg(F.min(F.struct("arrival", "hash")).alias("_first"))
    judged = blocks.join(first, "prev_hash")
    is_first = F.col("hash") == F.col("_first.hash")
    return judged.filter(is_first).select(*blocks.columns), judged.filter(~is_first).select(*blocks.columns)


def link_chain(blocks: DataFrame, start_hash: str) -> DataFrame:
    """(hash, distance): number of steps from the start, null when not linked.

    Each parent has at most one child in ``blocks``. Every row points at an
    ancestor, and a round moves all pointers ``HOPS`` times along those of the
    round before, so they reach ``HOPS + 1`` times as far: n blocks take a
    logarithmic number of rounds. Rows that reached the start or a missing
    parent are set aside. The others point at different ancestors, and rows
    that are done within a round look up themselves, so no key is hot.
    """
    known = blocks.select(F.col("hash").alias("_parent"))
    pointers = (
        blocks.select("hash", F.col("prev_hash").alias("ancestor"))
        .join(known, F.col("ancestor") == F.col("_parent"), "left")
        .select(
            "hash",
            "ancestor",
            F.lit(1).cast("long").alias("steps"),
            F.col("_parent").isNull().alias("done"),
        )
    )
    current = materialize(pointers, "chain")
    finished = []
    while True:
        finished.append(current.filter("done"))
        moving = current.filter("not done")
        if moving.isEmpty():
            break
        target = reduce(DataFrame.unionByName, finished[:-1], current).select(
            F.col("hash").alias("_at"),
            F.col("ancestor").alias("_next"),
            F.col("steps").alias("_more"),
            F.col("done").alias("_done"),
        )
        for _ in range(HOPS):
            at = F.when(F.col("done"), F.col("hash")).otherwise(F.col("ancestor"))
            step = F.when(F.col("done"), F.lit(0).cast("long")).otherwise(F.col("_more"))
            moving = moving.withColumn("_at", at).join(target, "_at").select(
                "hash",
                F.when(F.col("done"), F.col("ancestor")).otherwise(F.col("_next")).alias("ancestor"),
                (F.col("steps") + step).alias("steps"),
                (F.col("done") | F.col("_done")).alias("done"),
            )
        current = materialize(moving, "chain")
    out = reduce(DataFrame.unionByName, finished)
    return out.select("hash", F.when(F.col("ancestor") == start_hash, F.col("steps")).alias("distance"))


def order_blocks(arrivals: DataFrame, start_hash: str, start_height: int) -> DataFrame:
    """Every arrived block once, with its height and state.

    ``linked`` blocks form the chain from the start, ``pending`` ones wait for
    a parent, ``rejected`` ones are later children of a parent that has one.
    """
    once = materialize(first_arrivals(arrivals), "arrived")
    kept, rejected = eldest_children(once)
    kept = materialize(kept, "kept")
    linked = link_chain(kept, start_hash)
    height = F.lit(start_height) + F.col("distance")
    placed = kept.join(linked, "hash").select(
        "hash",
        "prev_hash",
        height.alias("height"),
        F.when(F.col("distance").isNotNull(), "linked").otherwise("pending").alias("state"),
    )
    refused = rejected.select(
        "hash", "prev_hash", F.lit(None).cast("long").alias("height"), F.lit("rejected").alias("state")
    )
    return placed.unionByName(refused)


def gaps(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent is not the block before them in time order."""
    keyed = blocks.select("hash", "prev_hash", "timestamp").withColumn("_all", F.lit(1))
    paired = previous_value(keyed, ["_all"], ["timestamp", "hash"], "hash", "before")
    return paired.filter(F.col("before") != F.col("prev_hash")).select("hash", "prev_hash", "before")


def blocks_in_time_order(blocks: DataFrame) -> DataFrame:
    """One block per hash with its position in time order."""
    once = blocks.dropDuplicates(["hash"]).withColumn("_all", F.lit(1))
    return row_position(once, ["_all"], ["timestamp", "hash"], "position").drop("_all")


def truncate_at(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks before the target (column ``hash``), all of them when it is absent."""
    limit = blocks.join(target, "hash", "left_semi").agg(F.min("height")).scalar()
    return blocks.filter(F.coalesce(F.col("height") < limit, F.lit(True)))


def renumber_heights(df: DataFrame, start_height: int, floor: int = 0) -> DataFrame:
    """Shift heights from ``floor`` on behind the start height; lower ones stay."""
    shifted = F.when(F.col("height") >= floor, F.col("height") + start_height + 1).otherwise(F.col("height"))
    return df.withColumn("height", shifted.cast(df.schema["height"].dataType))


def max_height(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.coalesce(F.max("height"), F.lit(0)).alias("height"))


def last_block(blocks: DataFrame) -> DataFrame:
    """The block at the greatest height: no row when there are no blocks."""
    top = F.max_by(F.struct(*blocks.columns), "height").alias("top")
    return blocks.agg(top).filter("top is not null").select("top.*")


def start_timestamp(blocks: DataFrame, threshold: int) -> DataFrame:
    """Earliest timestamp, null unless there are more than ``threshold`` blocks."""
    known = F.when(F.count(F.lit(1)) > threshold, F.min("timestamp"))
    return blocks.agg(known.alias("start_timestamp"))


def chain_tip_reached(blocks: DataFrame, now: Column) -> DataFrame:
    newest = F.max_by("timestamp", "height")
    reached = F.coalesce(timestamp_age_sec(newest, now) < CAUGHT_UP_SEC, F.lit(False))
    return blocks.agg(reached.alias("caught_up"))


def orphan_signals(arrivals: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Arrived blocks that are older than the earliest known one."""
    return arrivals.filter(F.col("timestamp") < start_timestamp(known, threshold).scalar())


def roll_back_tip(
    blocks: DataFrame, tx: DataFrame, utxo: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, tx, utxo, orphan) after the tip was taken off.

    Outputs that the removed transactions had spent do not come back.
    """
    tip = blocks.agg(F.max("height")).scalar()

    def below(df: DataFrame) -> DataFrame:
        return df.filter(F.col("height") != tip)

    header = ["height", "hash", "version", "prev_hash", "merkle_root", "timestamp", "bits", "nonce"]
    orphan = last_block(blocks).select(*header)
    return below(blocks), below(tx), below(utxo), orphan
