"""Positions, predecessors and running sums in groups of any size.

Rows are range-partitioned by (group, order): a large group is spread over
many pieces of about equal size, each piece is numbered on its own, and what
the earlier pieces of the group contribute is added from a summary with one
row per piece. Only groups that cross a partition boundary need that summary,
so it has fewer rows than there are partitions and can be broadcast.

A caller that knows its groups to be small, such as the outputs of one
transaction, says so with ``bounded``; a group is then sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _pieces(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with a piece number; pieces of a group follow its order.

    ``_tie`` spreads rows that are equal in every order column. The result is
    written, as a recomputed range partitioning may place rows differently.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c) for c in (*group, *order, "_tie")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tied.repartitionByRange(parts, *keys).withColumn("_piece", F.spark_partition_id())
    return materialize(ranged, "pieces")


def _crossing(pieces: DataFrame, group: list[str], *aggs: Column) -> DataFrame:
    """One summary row per (group, piece), for groups on more than one piece."""
    per_piece = pieces.groupBy(*group, "_piece").agg(*aggs)
    of_group = Window.partitionBy(*group)
    return per_piece.withColumn("_n", F.count(F.lit(1)).over(of_group)).filter("_n > 1").drop("_n")


def _attach(rows: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*group, "_piece")]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    extra = [F.col(f"s.{c}") for c in summary.columns if c not in (*group, "_piece")]
    # At most one row per partition boundary and side, see _crossing.
    small = F.broadcast(summary.alias("s"))
    return rows.alias("r").join(small, cond, "left").select("r.*", *extra)


def row_position(
    df: DataFrame, group: list[str], order: list[str], out: str, bounded: bool = False
) -> DataFrame:
    """0-based position of each row in its group."""
    return running_sum(df, group, order, F.lit(1), out, bounded)


def running_sum(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: Column,
    out: str,
    bounded: bool = False,
) -> DataFrame:
    """Sum of ``value`` (whole numbers) over the rows before this one in the group."""
    source = df.withColumn("_v", value.cast("long"))
    order_cols = [F.col(c) for c in order]
    if bounded:
        before = Window.partitionBy(*group).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
        return source.withColumn(out, F.coalesce(F.sum("_v").over(before), F.lit(0))).drop("_v")
    pieces = _pieces(source, group, order)
    here = (
        Window.partitionBy(*group, "_piece")
        .orderBy(*order_cols, "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    summary = _crossing(pieces, group, F.sum("_v").alias("_s")).withColumn("_base", F.sum("_s").over(earlier))
    rows = pieces.withColumn("_w", F.coalesce(F.sum("_v").over(here), F.lit(0)))
    joined = _attach(rows, summary.drop("_s"), group)
    total = F.col("_w") + F.coalesce(F.col("_base"), F.lit(0))
    return joined.withColumn(out, total).drop("_v", "_w", "_base", "_piece", "_tie")


def previous_value(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    out: str,
    bounded: bool = False,
) -> DataFrame:
    """Value of the row just before this one in its group, null for the first.

    ``value`` must not be null.
    """
    order_cols = [F.col(c) for c in order]
    if bounded:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*group).orderBy(*order_cols)))
    pieces = _pieces(df, group, order)
    here = Window.partitionBy(*group, "_piece").orderBy(*order_cols, "_tie")
    last = F.max(F.struct(*order_cols, F.col("_tie"), F.col(value).alias("_value")))
    before = F.lag("_last").over(Window.partitionBy(*group).orderBy("_piece"))
    summary = _crossing(pieces, group, last.alias("_last")).withColumn("_from", before["_value"]).drop("_last")
    rows = pieces.withColumn("_w", F.lag(value).over(here))
    joined = _attach(rows, summary, group)
    return joined.withColumn(out, F.coalesce("_w", "_from")).drop("_w", "_from", "_piece", "_tie")
