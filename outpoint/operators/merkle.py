"""Merkle roots, tree nodes, inclusion proofs and their verification.

Leaves are folded in chunks of 2**SPAN_LEVELS: a chunk is a bounded array, all
its levels are computed in one pass, and the tops of the chunks are the leaves
of the next pass. A block with a third of all transactions is spread over many
chunks, and even 10**12 leaves need four shuffles.

Folded chunks can be kept as a table, written when a block is: a proof then
reads the chunks on its way up, and nothing is folded again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash256, restored, reverse_hex, short, to_hex
from ..session import materialize
from ..sources.keyed import KeyedTable
from .maintenance import delete_keys, matching

#: Schema and key of kept trees: a row per block, pass and chunk.
TREES = "height bigint, pass int, chunk bigint, done boolean, levels array<array<binary>>"
TREE_KEYS = ["height", "pass", "chunk"]

SPAN_LEVELS = 10
BRANCHES = "array<struct<hash:string,pos:string>>"


def _parents(nodes: Column) -> Column:
    """Next level up; the last node of an odd level is paired with itself."""
    lefts = F.sequence(F.lit(1), F.size(nodes), F.lit(2))
    return F.transform(
        lefts,
        lambda i: hash256(
            F.concat(F.element_at(nodes, i), F.coalesce(F.get(nodes, i), F.element_at(nodes, i)))
        ),
    )


def _fold(nodes: DataFrame) -> DataFrame:
    """(height, chunk, levels, done): the levels of each chunk, leaves first.

    A first chunk that is not full is the whole block, so it stops at its
    root. All others climb every level: what is left over on the right pairs
    with itself until it meets the other chunks.
    """
    span = 1 << SPAN_LEVELS
    members = F.array_sort(F.collect_list(F.struct("pos", "node")))
    chunked = (
        nodes.groupBy("height", F.floor(F.col("pos") / span).alias("chunk"))
        .agg(members.alias("members"))
        .withColumn("done", (F.col("chunk") == 0) & (F.size("members") < span))
    )
    leaves = F.transform("members", lambda m: m["node"])
    steps = F.sequence(F.lit(1), F.lit(SPAN_LEVELS))

    def climb(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(F.col("done") & (F.size(top) == 1), levels).otherwise(F.concat(levels, F.array(_parents(top))))

    return chunked.select("height", "chunk", F.reduce(steps, F.array(leaves), climb).alias("levels"), "done")


def _passes(txs: DataFrame, wanted: DataFrame | None = None, whole: bool = False) -> list[DataFrame]:
    """Folded chunks of each pass; the tops of one are the leaves of the next.

    Of a chunk only its ``top`` is kept, and its ``levels`` where one of the
    ``wanted`` nodes (height, pos) or what became of it is in it, or if the
    trees are wanted ``whole``.
    """
    node = F.unhex(reverse_hex(F.col("hash")))
    nodes = txs.select("height", F.col("blockindex").cast("long").alias("pos"), node.alias("node"))
    span = 1 << SPAN_LEVELS
    passes = []
    while True:
        folded = _fold(nodes).withColumn("top", F.element_at(F.element_at("levels", -1), 1))
        if wanted is None and not whole:
            folded = folded.drop("levels")
        elif wanted is not None:
            asked = wanted.select("height", F.floor(F.col("pos") / span).alias("chunk")).distinct()
            wanted = asked.withColumnRenamed("chunk", "pos")
            folded = folded.join(asked.withColumn("_asked", F.lit(True)), ["height", "chunk"], "left")
            folded = folded.withColumn("levels", F.when(F.col("_asked"), F.col("levels"))).drop("_asked")
        folded = materialize(folded, "merkle")
        passes.append(folded)
        rest = folded.filter(~F.col("done"))
        if rest.isEmpty():
            return passes
        nodes = rest.select("height", F.col("chunk").alias("pos"), F.col("top").alias("node"))


def merkle_roots(txs: DataFrame) -> DataFrame:
    """(height, merkle_root) from transactions (hash, height, blockindex)."""
    roots = [
        folded.filter("done").select("height", reverse_hex(to_hex(F.col("top"))).alias("merkle_root"))
        for folded in _passes(txs)
    ]
    return reduce(DataFrame.unionByName, roots)


def _path(levels: Column, leaf: Column) -> Column:
    """Branches from a leaf of a chunk to its top."""

    def branch(level: Column) -> Column:
        nodes = F.element_at(levels, level + 1)
        own = F.call_function("shiftright", leaf, level)
        left_of = own % 2 == 0
        sibling = F.when(left_of, own + 1).otherwise(own - 1)
        # The last node of an odd level is its own sibling.
        node = F.coalesce(F.get(nodes, sibling), F.get(nodes, own))
        to_right = left_of & (sibling < F.size(nodes))
        return F.struct(
            reverse_hex(to_hex(node)).alias("hash"), F.when(to_right, "R").otherwise("L").alias("pos")
        )

    climbs = F.sequence(F.lit(0), F.size(levels) - 2)
    none = F.array().cast(BRANCHES)
    return F.when(F.size(levels) > 1, F.transform(climbs, branch)).otherwise(none)


def _paths(wanted: DataFrame, passes: list[DataFrame], heads: DataFrame | None = None) -> DataFrame:
    """``wanted`` nodes (height, pos and what else there is) of a pass with their ``branches``.

    A chunk is joined once with the list of its wanted nodes, which its span
    bounds; the way on from its top is worked out once for all of them. What
    ``heads`` has of a height is joined to chunks, too, so branches are made
    behind all joins.
    """
    span, key = 1 << SPAN_LEVELS, ["height", "chunk"]
    carried = [c for c in wanted.columns if c not in ("height", "pos")]
    place = (F.col("pos") % span).cast("int").alias("leaf")
    asked = wanted.groupBy("height", _chunk().alias("chunk")).agg(F.collect_list(F.struct(place, *carried)).alias("asked"))
    held = passes[0].join(asked, key)
    none = F.array().cast(BRANCHES)
    above = none
    if len(passes) > 1:
        upward = held.filter(~F.col("done")).select("height", F.col("chunk").alias("pos"))
        tops = _paths(upward, passes[1:]).select("height", F.col("pos").alias("chunk"), F.col("branches").alias("above"))
        held, above = held.join(tops, key, "left"), F.coalesce("above", none)
    shown = [] if heads is None else [c for c in heads.columns if c != "height"]
    held = held if heads is None else held.join(heads, "height")

    def path(a: Column) -> Column:
        own = [a[c].alias(c) for c in ("leaf", *carried)]
        return F.struct(*own, F.concat(_path(F.col("levels"), a["leaf"]), above).alias("branches"))

    found = held.select(*key, *shown, F.explode(F.transform("asked", path)).alias("found"))
    at = (F.col("chunk") * span + F.col("found.leaf")).alias("pos")
    return found.select("height", at, *[F.col(f"found.{c}").alias(c) for c in carried], *shown, "found.branches")


def _chunk() -> Column:
    return F.floor(F.col("pos") / (1 << SPAN_LEVELS))


def tree_rows(txs: DataFrame) -> DataFrame:
    """Rows of the table of trees for the blocks of ``txs`` (hash, height, blockindex)."""
    rows = [p.select("height", F.lit(i).alias("pass"), "chunk", "done", "levels") for i, p in enumerate(_passes(txs, whole=True))]
    return reduce(DataFrame.unionByName, rows)


def _kept_passes(placed: DataFrame, trees: KeyedTable) -> list[DataFrame]:
    """The chunks of the blocks of ``placed``, pass by pass, as they are kept."""
    held = materialize(trees.find(placed, "height"), "chunks")
    last = held.agg(F.max("pass")).first()[0] or 0
    return [held.filter(F.col("pass") == i) for i in range(last + 1)]


def merkle_proofs(keys: DataFrame, txs: DataFrame, blocks: DataFrame, trees: KeyedTable | None = None) -> DataFrame:
    """One proof per distinct requested hash.

    Columns: tx_hash, found, block_hash, merkle_root and branches, an array of
    (hash, pos) from the leaf up, with one entry per tree level. With kept
    ``trees``, only the places of the requested hashes are needed in ``txs``;
    without, the trees of their blocks are folded from all their transactions.
    """
    asked = short(keys.select("hash"))
    wanted, nameless = asked.filter("hash IS NOT NULL").distinct(), asked.filter("hash IS NULL").distinct()
    leaves = short(txs.select("hash", "height", F.col("blockindex").cast("long").alias("pos")))
    placed = materialize(matching(leaves, wanted, ["hash"]), "placed")
    if trees is not None:
        passes = _kept_passes(placed, trees)
    else:
        passes = _passes(txs.join(placed.select("height").distinct(), "height", "left_semi"), placed)
    heads = blocks.select("height", F.col("hash").alias("block_hash"), "merkle_root")
    proofs = _paths(placed, passes, heads).drop("height", "pos")
    # The hashes that have a proof, without working it out: their proofs need not be joined to the others.
    proven = matching(placed.withColumn("chunk", _chunk()), heads, ["height"])
    proven = matching(proven, passes[0], ["height", "chunk"])
    absent = delete_keys(wanted, proven, ["hash"]).unionByName(nameless)
    return restored(proofs.unionByName(absent, allowMissingColumns=True), keys.select("hash")).select(
        F.col("hash").alias("tx_hash"),
        F.col("block_hash").isNotNull().alias("found"),
        "block_hash",
        "merkle_root",
        "branches",
    )


def folded_root(tx_hash: Column, branches: Column) -> Column:
    """Root reached by folding the branches onto a transaction hash."""
    flip = lambda h: F.unhex(reverse_hex(h))
    climbed = F.reduce(
        branches,
        flip(tx_hash),
        lambda node, b: F.when(b["pos"] == "R", hash256(F.concat(node, flip(b["hash"])))).otherwise(
            hash256(F.concat(flip(b["hash"]), node))
        ),
    )
    return reverse_hex(to_hex(climbed))


def verify_merkle_proofs(proofs: DataFrame) -> DataFrame:
    return proofs.withColumn("verified", folded_root(F.col("tx_hash"), F.col("branches")) == F.col("merkle_root"))


def check_blocks(blocks: DataFrame, roots: DataFrame, bad_values: DataFrame, pow_ok: Column) -> DataFrame:
    """Whole-block validity: proof of work, output values and Merkle root.

    ``bad_values`` has a row per height with an output out of range.
    """
    computed = roots.withColumnRenamed("merkle_root", "computed_root")
    flagged = bad_values.select("height").distinct().withColumn("bad", F.lit(True))
    checked = blocks.join(computed, "height", "left").join(flagged, "height", "left")
    return checked.select(
        "hash",
        "height",
        pow_ok.alias("pow_ok"),
        F.col("bad").isNull().alias("values_ok"),
        F.coalesce(F.col("computed_root") == F.col("merkle_root"), F.lit(False)).alias("merkle_ok"),
    ).withColumn("valid", F.col("pow_ok") & F.col("values_ok") & F.col("merkle_ok"))
