"""Connected components of a link table by repeated contraction.

In a round every node points to whichever of itself and its neighbours comes
first in an order that is drawn anew each round; links are then rewritten to
the pointers, and links inside one pointer vanish. As the order is random, a
round shrinks any shape, long paths too, by a constant factor on average. The
pointers of all rounds are composed at the end and each component is named by
its smallest node.

The least neighbour is aggregated before it is shuffled, and all tables are
written to the shared folder, so that the hot node of a large star meets a
join with plain shuffles on both sides, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 200  # far more than the expected logarithm; reached only by a fault


def _key(column: str, turn: int):
    return F.struct(F.xxhash64(F.col(column), F.lit(turn)).alias("rank"), F.col(column).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component being its smallest node.

    Links with a null are ignored, repeated links and loops do no harm; a node
    that only has a loop is its own component. No links give no rows.
    """
    real = written(links.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "links")
    edges = real.filter("a <> b")
    pointers = None
    for turn in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(_key("b", turn)).alias("near"))
        to = F.least(_key("a", turn), F.col("near"))["node"]
        step = written(first.select(F.col("a").alias("node"), to.alias("to")), "pointers")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        kept = moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = written(kept.distinct(), "links")
        if pointers is None:
            pointers = step
        else:
            then = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            pointers = pointers.join(then, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    else:
        raise RuntimeError("components did not settle")
    loops = real.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    if pointers is None:
        return loops
    pointers = written(pointers, "pointers")
    names = written(pointers.groupBy("to").agg(F.min("node").alias("component")), "names")
    found = pointers.join(names, "to").select("node", "component")
    return written(found.union(loops.join(found.select("node"), "node", "left_anti")), "components")
