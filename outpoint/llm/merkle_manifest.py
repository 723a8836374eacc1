"""Merkle manifest of a table: a digest per row, a tree per group, a root over the groups, a proof per row.

An aligned block of ``BLOCK`` nodes is one row that keeps each of its levels as
one hex string. The parents of a level are hashes of its substrings of two
digests, the sibling of a node is the substring beside it; both are column
expressions. What a block folds to is a node of the next pass, where again
``BLOCK`` of them make a block, until each group has one node. The nodes of
the groups are then one more sequence that is folded the same way. Texts are
hashed where they are read and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import row_position
from .common import crc_remainder, table, written

#: Levels of a full block, and its nodes. A block's lowest level is a string of 64 * BLOCK characters.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Columns that make a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose key has a CRC that this divides are tampered with in the query.
TAMPERED = 7


def leaf_digest(columns: list[Column]) -> Column:
    """Hash of the values one after the other: ``-`` for null, else byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _parents(level: Column) -> Column:
    """The next level: hashes of each two consecutive digests; a last one alone is hashed alone."""
    pairs = F.ceil(F.length(level) / 128).cast("int")
    made = F.transform(F.sequence(F.lit(0), pairs - 1), lambda k: F.sha2(F.substring(level, k * 128 + 1, F.lit(128)).cast("binary"), 256))
    return F.array_join(made, "")


def _folded(bottom: Column, folds: Column) -> Column:
    """All levels of a block, the given one first."""
    steps = F.when(folds > 0, F.sequence(F.lit(1), folds)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(bottom), lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))))


def _flanks(levels: Column, place: Column) -> Column:
    """Siblings of the node at ``place`` of a block, level by level: empty where its run has no other node."""

    def beside(level: Column, k: Column) -> Column:
        at = F.call_function("shiftright", place, k)
        other = at.bitwiseXOR(F.lit(1))
        node = F.substring(level, other * 64 + 1, F.lit(64))
        return F.struct((F.pmod(at, F.lit(2)) == 1).alias("left"), node.alias("node"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def fold(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and its proof lead to."""

    def up(node: Column, step: Column) -> Column:
        both = F.when(step["left"], F.concat(step["node"], node)).otherwise(F.concat(node, step["node"]))
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def _blocks(nodes: DataFrame, label: str) -> DataFrame:
    """Blocks of nodes (g, at, node, kept): g, block, rows (place, node, kept in order), levels, many.

    ``many`` says whether the group has more than this block. It does if this
    is not its first one, or if the first node of a second one exists, which
    is sent to the first block, too. A group is one block or folds every block
    whole, also a last one of few nodes.
    """
    mine = F.floor(F.col("at") / BLOCK).cast("long")
    sent = nodes.withColumn("block", F.explode(F.when(F.col("at") == BLOCK, F.array(mine, F.lit(0).cast("long"))).otherwise(F.array(mine))))
    place = (F.col("at") - F.col("block") * BLOCK).cast("int")
    found = sent.groupBy("g", "block").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "node", "kept"))).alias("all"))
    rows = F.filter("all", lambda r: r["place"] < BLOCK)
    found = found.select("g", "block", rows.alias("rows"), ((F.col("block") > 0) | (F.size("all") > F.size(rows))).alias("many"))
    # Rounds of a block that is alone: binary digits of one less than its nodes.
    alone = F.when(F.size("rows") > 1, F.length(F.bin(F.size("rows") - 1))).otherwise(0)
    folds = F.when(F.col("many"), F.lit(LEVELS)).otherwise(alone).cast("int")
    bottom = F.array_join(F.transform("rows", lambda r: r["node"]), "")
    return written(found.withColumn("levels", _folded(bottom, folds)), label)


def _trees(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every pass, lowest first, and the last node (g, top) of each group."""
    passes = []
    while True:
        blocks = _blocks(nodes, f"{label}-{len(passes)}")
        passes.append(blocks)
        tops = blocks.select("g", "block", "many", F.element_at("levels", -1).alias("node"))
        if tops.filter("many").isEmpty():
            return passes, tops.select("g", F.col("node").alias("top"))
        # A group that is one block already is one node from now on, which is its own block.
        nodes = tops.select("g", F.col("block").alias("at"), "node", F.lit(None).cast("string").alias("kept"))


def _rows(blocks: DataFrame, above: DataFrame | None, of_group: DataFrame | None = None) -> DataFrame:
    """g, at, node, kept and proof of the rows of blocks, and the columns of ``of_group``, whose proofs come last.

    ``above`` has the proof of what each block folds to.
    """
    none = F.array().cast("array<struct<left:boolean,node:string>>")
    blocks = blocks.withColumn("above", none) if above is None else blocks.join(above, ["g", "block"])
    more = []
    if of_group is not None:  # joined by the block and not by the row
        blocks = blocks.join(of_group, "g").withColumn("above", F.concat("above", "to_root"))
        more = [c for c in of_group.columns if c not in ("g", "to_root")]
    own = F.transform("rows", lambda r: F.struct(r["place"].alias("place"), r["node"].alias("node"), r["kept"].alias("kept"), _flanks(F.col("levels"), r["place"]).alias("own")))
    rows = blocks.select("g", "block", "above", *more, F.explode(own).alias("r"))
    at = (F.col("block") * BLOCK + F.col("r.place")).alias("at")
    return rows.select("g", at, "r.node", "r.kept", F.concat("r.own", "above").alias("proof"), *more)


def _above(passes: list[DataFrame]) -> DataFrame | None:
    """(g, block, above) of the lowest blocks, None where they are the only ones."""
    above = None
    for blocks in reversed(passes[1:]):
        found = _rows(blocks, above).select("g", F.col("at").alias("block"), F.col("proof").alias("above"))
        above = written(found, "proofs")
    return above


def manifest(df: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``df``: ``order``, the columns of ``keep``, leaf, proof, subroot and root.

    Leaves of a group stand in the order of ``order``, null first, rows that
    repeat it by their leaf. A null group is a group, the first one; groups
    stand in the order of their bytes. ``proof`` has an element (left, node)
    per level, from the leaf to the subroot and on to the root; ``node`` is
    empty where a run has no other node. A group of any size is spread over
    blocks, and blocks over tasks. An empty table has no rows. Columns that
    are not named have no part in it.
    """
    kept = F.struct(F.col(f"`{order}`").alias(order), *[c.alias(name) for name, c in (keep or {}).items()]).alias("kept")
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g")
    leaves = df.select(g, F.col(f"`{order}`").alias("key"), leaf_digest([F.col(f"`{c}`") for c in columns]).alias("node"), kept)
    placed = row_position(leaves, ["g"], ["key", "node"], "at")
    passes, tops = _trees(placed.select("g", "at", "node", "kept"), "levels")

    named = tops.select(F.lit("").alias("all"), F.col("g").alias("kept"), F.col("top").alias("node"))
    groups = row_position(written(named, "subroots"), ["all"], ["kept"], "at")
    upper, last = _trees(groups.select(F.col("all").alias("g"), "at", "node", "kept"), "groups")
    roots = _rows(upper[0], _above(upper)).select(F.col("kept").alias("g"), F.col("proof").alias("to_root"), F.col("node").alias("subroot"))
    roots = written(roots.withColumn("root", last.select("top").scalar()), "roots")
    return _rows(passes[0], _above(passes), roots).select("kept.*", F.col("node").alias("leaf"), "proof", "subroot", "root")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of ``documents``, and what proofs say of rows whose n_chars is one too large."""
    docs = table(spark, folder, "documents").select(*COLUMNS)
    changed = crc_remainder("doc_id", TAMPERED) == 0
    touched = [F.col(c) + F.lit(1) if c == "n_chars" else F.col(c) for c in COLUMNS]
    found = manifest(docs, keep={"_now": F.when(changed, leaf_digest(touched))})
    siblings = F.array_join(F.transform("proof", lambda s: s["node"]), "")
    folded = fold(F.coalesce("_now", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _h(*values: str) -> str:
    parts = " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values)
    return f"sha256({parts})"


OP13_SQL = f"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                ORDER BY i) AS t
    FROM range(256) r(i)
),
leaves AS (
    SELECT doc_id, lang, {_h(*COLUMNS)} AS leaf, {_h("doc_id", "source", "lang", "n_chars + 1", "text")} AS touched,
           xor(4294967295, list_reduce(
               list_concat([4294967295], list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS crc
    FROM documents, crc_table
),
placed AS (
    SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n
    FROM leaves
),
tree AS (
    SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1
    GROUP BY lang, level, pos // 2, n
),
subroots AS (
    SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
    FROM tree WHERE n = 1
),
top AS (
    SELECT 0 AS level, pos, n, subroot AS node FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
),
steps AS (
    SELECT p.id, l.level AS step, CASE WHEN (p.pos >> l.level) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(t.node, '') AS beside
    FROM placed p JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.level = l.level AND t.pos = xor(p.pos >> l.level, 1)
    UNION ALL
    SELECT p.id, 1000 + l.level, CASE WHEN (s.pos >> l.level) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(t.node, '')
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l ON TRUE
    LEFT JOIN top t ON t.level = l.level AND t.pos = xor(s.pos >> l.level, 1)
),
proofs AS (
    SELECT id, list(beside ORDER BY step) AS way FROM steps GROUP BY id
),
folded AS (
    SELECT p.doc_id, p.leaf, s.subroot, (SELECT node FROM top WHERE n = 1) AS root,
           sha256(array_to_string(list_transform(coalesce(w.way, []), lambda e: e[2:]), '')) AS proof_sha256,
           list_reduce(list_concat([CASE WHEN p.crc % {TAMPERED} = 0 THEN p.touched ELSE p.leaf END], coalesce(w.way, [])),
                       lambda acc, e: sha256(CASE WHEN e[1] = 'L' THEN e[2:] || acc ELSE acc || e[2:] END)) AS folded_root
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proofs w ON w.id = p.id
)
SELECT *, folded_root = root AS verified FROM folded
"""
