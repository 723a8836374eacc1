"""Who holds a transaction, for histories of any depth.

The holder of a transaction is the least of its own match and what its parents
pass on. Along a chain of transactions with one parent each that is a small
function of the holder at the upper end, and such functions compose, so
pointers that double their reach skip the chain in a logarithmic number of
rounds. What is left is a smaller graph in which parents that are settled are
folded into their children, which makes new chains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Pointer moves per round: fewer rounds to write, for more joins in each.
HOPS = 3

LONGEST = 2**63 - 1
PIECES = "array<struct<under:int, then:int>>"


class Passing:
    """Which holders pass on what they hold, and when.

    ``spans`` has (since, until) per priority, None for those that never do.
    Between two bounds of spans, an epoch, the answer does not change; an epoch
    is named by the bound that it begins with.
    """

    def __init__(self, spans: list[tuple[int, int] | None]):
        spans = [s or (LONGEST, -LONGEST) for s in spans]
        self.bounds = sorted({b for since, until in spans for b in (since, until + 1) if -LONGEST < b < LONGEST and since <= until})
        self.since = F.array(*[F.lit(s).cast("long") for s, _ in spans])
        self.until = F.array(*[F.lit(u).cast("long") for _, u in spans])

    @property
    def timed(self) -> bool:
        return bool(self.bounds)

    def epoch(self, at: Column) -> Column:
        start = F.lit(-LONGEST).cast("long")
        if not self.timed:
            return start
        begun = F.filter(F.array(*[F.lit(b).cast("long") for b in self.bounds]), lambda b: b <= at)
        return F.coalesce(F.array_max(begun), start)

    def passed(self, holder: Column, epoch: Column) -> Column:
        return F.when(epoch.between(F.get(self.since, holder), F.get(self.until, holder)), holder)

    def follow(self, pieces: Column, holder: Column, epoch: Column) -> Column:
        """The holder at the lower end of a chain, from the one at the upper end.

        ``pieces`` are the own matches on the way that are each smaller than
        all before, with what comes of them: the first that is less than the
        holder takes over.
        """
        value = self.passed(holder, epoch)
        over = F.filter(pieces, lambda p: value.isNull() | (p["under"] < value))
        return F.when(F.size(over) > 0, F.get(over, F.lit(0))["then"]).otherwise(value)

    def compose(self, upper: Column, lower: Column, epoch: Column) -> Column:
        """Pieces of two chains of one epoch, one below the other."""
        least = F.get(upper, F.size(upper) - 1)["under"]
        first = F.transform(
            upper, lambda p: F.struct(p["under"].alias("under"), self.follow(lower, p["then"], epoch).alias("then"))
        )
        return F.concat(first, F.filter(lower, lambda p: least.isNull() | (p["under"] < least)))


def _no_pieces() -> Column:
    return F.array().cast(PIECES)


def skip_chains(links: DataFrame, passing: Passing) -> DataFrame:
    """``links`` (hash, epoch, prev_hash, pieces), each led to the first ancestor that is no link itself.

    Rows that are done are set aside, and within a round look up themselves,
    so no key is hot.
    """
    known = links.select(F.col("hash").alias("_at"))
    started = links.join(known, F.col("prev_hash") == F.col("_at"), "left").withColumn("done", F.col("_at").isNull())
    current = materialize(started.drop("_at"), "pointers")
    finished = []
    while True:
        finished.append(current.filter("done"))
        moving = current.filter("not done")
        if moving.isEmpty():
            break
        target = reduce(DataFrame.unionByName, finished[:-1], current).select(
            F.col("hash").alias("_at"), F.col("prev_hash").alias("_next"), F.col("pieces").alias("_upper"), F.col("done").alias("_done")
        )
        for _ in range(HOPS):
            at = F.when(F.col("done"), F.col("hash")).otherwise(F.col("prev_hash"))
            composed = passing.compose(F.col("_upper"), F.col("pieces"), F.col("epoch"))
            moving = moving.withColumn("_at", at).join(target, "_at").select(
                "hash",
                "epoch",
                F.when(F.col("done"), F.col("prev_hash")).otherwise(F.col("_next")).alias("prev_hash"),
                F.when(F.col("done"), F.col("pieces")).otherwise(composed).alias("pieces"),
                (F.col("done") | F.col("_done")).alias("done"),
            )
        current = materialize(moving, "pointers")
    return reduce(DataFrame.unionByName, finished).drop("done")


def settle(edges: DataFrame, own: DataFrame, passing: Passing) -> DataFrame:
    """(hash, priority) of every transaction that has a parent in ``edges``, null if nobody holds it.

    ``edges`` has (hash, prev_hash, epoch), the same epoch in all rows of a
    hash, and no cycle; ``own`` has (hash, own), what matches by itself.

    A round folds parents that are settled into their children, then takes out
    all transactions with one parent left. Their links are kept aside and
    resolved from the last round back. A chain of n costs a logarithm of n
    however many untracked parents join it, and so do detours that come
    together again without a match between; a graph in which different
    captures mix at every step costs a round per step.
    """
    edges = materialize(edges.distinct().withColumn("pieces", _no_pieces()), "open")
    own = materialize(own.groupBy("hash").agg(F.min("own").alias("own")), "own")
    settled, layers = [], []
    while not edges.isEmpty():
        waiting = materialize(edges.select(F.col("hash").alias("prev_hash")).distinct().withColumn("open", F.lit(True)), "heads")
        parents = own.select(F.col("hash").alias("prev_hash"), F.col("own").alias("prev_own"))
        judged = materialize(edges.join(waiting, "prev_hash", "left").join(parents, "prev_hash", "left"), "judged")
        value = passing.passed(passing.follow(F.col("pieces"), F.col("prev_own"), F.col("epoch")), F.col("epoch"))
        nodes = (
            judged.groupBy("hash")
            .agg(F.min(F.when(F.col("open").isNull(), value)).alias("inherited"), F.count("open").alias("parents"))
            .join(own, "hash", "left")
            .select("hash", F.least("own", "inherited").alias("own"), "parents")
        )
        nodes = materialize(nodes, "nodes")
        settled.append(nodes.filter("parents = 0").select("hash", F.col("own").alias("priority")))
        own = nodes.select("hash", "own")
        rest = judged.filter("open").select("hash", "epoch", "prev_hash", "pieces").join(nodes, "hash")
        rest = materialize(rest, "rest")
        single = rest.filter("parents = 1")
        if passing.timed:
            # A link ends where a child sees another epoch.
            seen = rest.select(F.col("prev_hash").alias("hash"), F.col("epoch").alias("_epoch"))
            border = seen.join(single.select("hash", "epoch"), "hash").filter("epoch != _epoch").select("hash").distinct()
            single = single.join(border, "hash", "left_anti")
        itself = F.when(F.col("own").isNull(), _no_pieces()).otherwise(
            F.array(F.struct(F.col("own").alias("under"), F.col("own").alias("then"))).cast(PIECES)
        )
        links = single.select("hash", "epoch", "prev_hash", passing.compose(F.col("pieces"), itself, F.col("epoch")).alias("pieces"))
        skipped = skip_chains(materialize(links, "links"), passing)
        layers.append(skipped)
        way = skipped.select(F.col("hash").alias("prev_hash"), F.col("prev_hash").alias("_next"), F.col("pieces").alias("_upper"))
        left = rest.join(skipped.select("hash"), "hash", "left_anti").join(way, "prev_hash", "left")
        joined = F.when(F.col("_next").isNull(), F.col("pieces")).otherwise(
            passing.compose(F.col("_upper"), F.col("pieces"), F.col("epoch"))
        )
        left = left.select("hash", "epoch", F.coalesce("_next", "prev_hash").alias("prev_hash"), joined.alias("pieces"))
        edges = materialize(left.distinct(), "open")
    if not settled:
        return own.select("hash", F.col("own").alias("priority")).limit(0)
    held = reduce(DataFrame.unionByName, settled)
    for layer in reversed(layers):
        above = held.select(F.col("hash").alias("prev_hash"), F.col("priority").alias("_above"))
        value = passing.follow(F.col("pieces"), F.col("_above"), F.col("epoch"))
        below = materialize(layer.join(above, "prev_hash", "left").select("hash", value.alias("priority")), "resolved")
        held = held.unionByName(below)
    return held
