"""Mixing sources to target weights by a temperature.

The weights are the sources' token shares to the power of one exponent: 1
keeps the corpus, 0 gives every source the same. The exponent is found by
bisection, so that the weights have a target entropy, or so that no source is
repeated more often than a limit. Every step looks at a grid of exponents in
one aggregation over the sources, so few jobs replace many halvings.

The weights become budgeted block permutations. Each pass over a source deals
its documents anew into blocks, by a hash, and orders them. A source whose
budget is 2.3 passes gives two whole ones, and of the third the documents
that come first, as far as the budget goes. ``turn`` places each block in the
whole run, so that every part of the run has all sources in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: No source is repeated more often than this, in tokens over its own tokens.
REPEATS = 1.5
#: Tokens of a block, on average.
BLOCK_TOKENS = 1 << 20
SEED = 20240229
#: Largest exponent tried for a target entropy; above 1 large sources gain.
SHARPEST = 16.0
#: Exponents that one job tries, and jobs: together finer than 1e-9.
GRID, STEPS = 32, 6
_UNIT = float(1 << 53)


def _tokens() -> Column:
    """Words of the text, runs without white space."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key() -> Column:
    """A name for the source that tells null from text."""
    source = F.col("source").cast("string")
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source))


def _draw(copy: Column, id_column: Column, text: Column) -> Column:
    """Place of a document in a pass, evenly spread over 0 to 1."""
    drawn = F.xxhash64(text, id_column, copy, F.lit(SEED))
    return F.shiftrightunsigned(drawn, 11).cast("double") / F.lit(_UNIT)


def entropy(exponent: Column) -> Column:
    """Entropy in nats of the weights that ``share`` to the power of ``exponent`` gives, as an aggregate."""
    power = F.pow("share", exponent)
    total = F.sum(power)
    return F.log(total) - exponent * F.sum(power * F.log("share")) / total


def largest_repeat(exponent: Column) -> Column:
    """Most passes over any source, when every source has one at least."""
    gain = F.pow("share", exponent - 1)
    return F.max(gain) / F.min(gain)


def find_exponent(sources: DataFrame, measure: Callable[[Column], Column], target: float, high: float = 1.0) -> float:
    """The least exponent in 0..high at which ``measure``, which falls with it, is at most ``target``; high if none."""
    low = 0.0
    for _ in range(STEPS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        found = sources.agg(*[measure(F.lit(x)).alias(f"m{i}") for i, x in enumerate(grid)]).first()
        fits = [i for i, value in enumerate(found) if value is not None and value <= target + 1e-12]
        if not fits:
            return high
        if fits[0] == 0:
            return grid[0]
        low, high = grid[fits[0] - 1], grid[fits[0]]
    return high


def plan(sizes: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """A row per source: key, tokens, share, weight, passes, copies, cut.

    ``sizes`` has key, doc_id, text_hash columns as ``_sized`` makes them.
    ``target_entropy`` (nats) or else ``repeats`` sets the exponent. ``budget``
    is in tokens; without one it is the least with which every source is
    passed once. A document is in pass ``copies`` if its draw is up to ``cut``.
    Sources without tokens get one pass.
    """
    tokens = written(sizes.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    full = tokens.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    if target_entropy is not None:
        exponent = find_exponent(full, entropy, target_entropy, SHARPEST)
    elif repeats is not None:
        exponent = find_exponent(full, largest_repeat, repeats)
    else:
        exponent = 1.0
    power = F.pow("share", F.lit(exponent))
    gain = F.pow("share", F.lit(exponent - 1))
    norm = full.agg(F.sum(power), F.min(gain)).first()
    weight = power / F.lit(norm[0] or 1.0)
    passes = gain / F.lit(norm[1] or 1.0) if budget is None else F.lit(float(budget)) * weight / F.col("tokens")
    planned = full.withColumn("weight", weight).withColumn("passes", passes)
    planned = planned.withColumn("copies", F.floor("passes").cast("long"))
    planned = written(planned.withColumn("part", F.floor((F.col("passes") - F.col("copies")) * F.col("tokens")).cast("long")), "passes")
    # The last pass of a source: blocks in order as long as they fit, then documents of the block where the budget ends.
    blocks = F.ceil(F.col("tokens") / BLOCK_TOKENS)
    open_ = planned.filter("part > 0").select("key", "copies", "part", blocks.alias("blocks"))
    last = sizes.join(open_, "key").withColumn("draw", _draw(F.col("copies"), F.col("doc_id"), F.col("text_hash")))
    last = written(last.select("key", "part", "draw", "n_tokens", F.floor(F.col("draw") * F.col("blocks")).alias("block")), "last")
    in_order = Window.partitionBy("key").orderBy("block")
    by_block = last.groupBy("key", "part", "block").agg(F.sum("n_tokens").alias("n"))
    ends = by_block.withColumn("end", F.sum("n").over(in_order)).withColumn("before", F.col("end") - F.col("n"))
    edge = written(ends.filter("before <= part AND end > part").groupBy("key", "part").agg(F.min(F.struct("block", "before")).alias("edge")).select("key", "edge.block", "edge.before"), "edge")
    inside = last.join(edge, ["key", "block"])
    sums = inside.groupBy("key", "part", "before", "draw").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("draw"))
    over = sums.withColumn("over", F.col("before") + upto > F.col("part")).filter("over").groupBy("key").agg(F.min("draw").alias("cut"))
    cut = F.when(F.col("part") > 0, F.coalesce("cut", F.lit(2.0))).otherwise(0.0)
    placed = planned.join(over, "key", "left").select("key", "tokens", "share", "weight", "passes", "copies", cut.alias("cut"))
    none = tokens.filter("tokens = 0")
    zero = F.lit(0.0)
    return written(placed.union(none.select("key", "tokens", zero, zero, F.lit(1.0), F.lit(1).cast("long"), zero)), "plan")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _tokens().alias("n_tokens"))


def _scheduled(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` (key, doc_id, text_hash and more), once per pass that they are in, with copy, draw and turn."""
    joined = rows.join(planned.select("key", "tokens", "passes", "copies", "cut"), "key")
    whole = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    in_last = _draw(F.col("copies"), F.col("doc_id"), F.col("text_hash")) < F.col("cut")
    passes = F.concat(whole, F.when(in_last, F.array("copies")).otherwise(F.array().cast("array<bigint>")))
    each = joined.withColumn("copy", F.explode(passes)).withColumn("draw", _draw(F.col("copy"), F.col("doc_id"), F.col("text_hash")))
    blocks = F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1))
    block = F.floor(F.col("draw") * blocks).cast("long")
    done = F.least(F.col("copy") + (block + 0.5) / blocks, F.col("passes"))
    return each.withColumn("block", block).withColumn("turn", done / F.col("passes"))


def schedule(docs: DataFrame, **target) -> DataFrame:
    """The mixture as a row per document and pass: doc_id, source, n_tokens, copy, block, place, turn.

    Training takes blocks by ``turn`` and documents in a block by ``place``.
    Null sources are one source; a null doc_id or text is mixed like any other
    (no tokens for a null text); repeated rows are dealt together; see ``plan``
    for the options.
    """
    sized = docs.select(F.col("source").alias("source"), _key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _tokens().alias("n_tokens"))
    sized = written(sized, "sized")
    planned = plan(sized.drop("source"), **target)
    found = _scheduled(sized, planned)
    return found.select("doc_id", "source", "n_tokens", "copy", "block", F.col("draw").alias("place"), "turn")


def mix(docs: DataFrame, **target) -> DataFrame:
    """``docs`` with all columns, each row as often as its source's passes take it."""
    sized = written(_sized(docs), "sized")
    planned = plan(sized, **target)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, _key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return _scheduled(rows, planned).select("row.*")


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return schedule(table(spark, folder, "documents"))
