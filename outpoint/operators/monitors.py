"""Monitors and the collections of transactions they capture.

Monitors are configuration, tried in order. A few real patterns become literal
conditions in the plan, many share an index. Monitors of one pay-to-pubkey-hash script, which is
what an address makes and what there may be many of, are a table that is
joined with the scripts of that form which an output script holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validate
from ..functions.scripts import address_to_lock_script
from ..session import compact_writer, materialize, new_path
from .descent import LONGEST, Passing, settle
from .patterns import indexed_matches, required_run

# Fixed value.
BROADCAST = "broadcast"
FOREVER = 2**63 - 1

#: Generations of descendants that are followed one by one; deeper histories are contracted.
GENERATIONS = 6

#: Up to this many patterns are tried one by one.
FEW_PATTERNS = 16

# The script of an address; the lookahead finds it at every place of a script.
ADDRESS_SCRIPT = "76a914[0-9a-f]{40}88ac"


@dataclass(frozen=True)
class Monitor:
    """A rule. It is active for arrival numbers in [valid_from, valid_to).

    The arrival is the column ``at`` of the rows in question, or else ``seq``.
    """

    name: str
    track_descendants: bool = False
    address: str | None = None
    locking_script_pattern: str | None = None
    valid_from: int | None = None
    valid_to: int | None = None


MONITOR_SCHEMA = (
    "name string, track_descendants boolean, address string, locking_script_pattern string, "
    "valid_from bigint, valid_to bigint"
)


def monitors_frame(spark: SparkSession, monitors: list[Monitor], numbered: bool = False) -> DataFrame:
    """A table of monitors, with their ``position`` if ``numbered``."""
    rows = [
        (i, m.name, m.track_descendants, m.address, m.locking_script_pattern, m.valid_from, m.valid_to)
        for i, m in enumerate(monitors)
    ]
    table = spark.createDataFrame(rows, "position int, " + MONITOR_SCHEMA)
    return table if numbered else table.drop("position")


def monitors_of(table: DataFrame) -> list[Monitor]:
    """Monitors from a table with ``MONITOR_SCHEMA``, in ``position`` order if it has one."""
    names = [c.split()[0] for c in MONITOR_SCHEMA.split(", ")]
    ordered = table.orderBy("position") if "position" in table.columns else table
    return [Monitor(*row) for row in ordered.select(*names).collect()]


def with_patterns(spark: SparkSession, monitors: list[Monitor], network: str) -> list[Monitor]:
    """Monitors whose address, which wins over a pattern, became a pattern.

    Monitors that have neither, or an unusable address, are left out.
    """
    asked = [m for m in monitors if m.address is not None]
    scripts = {}
    if asked:
        frame = spark.createDataFrame([(m.address,) for m in asked], "address string")
        resolved = address_to_lock_script(frame, network).collect()  # one row per configured monitor
        scripts = {r["address"]: r["lock_script"] for r in resolved}
    out = []
    for m in monitors:
        pattern = m.locking_script_pattern if m.address is None else scripts[m.address]
        if pattern is not None:
            out.append(Monitor(m.name, m.track_descendants, None, pattern, m.valid_from, m.valid_to))
    return out


def change_monitors(spark: SparkSession, held: list[Monitor], taken: set[str], events: DataFrame, network: str) -> tuple[list[Monitor], list[tuple]]:
    """Monitors after ``events``, and (arrival, kind, name, reason) of those that were refused.

    ``events`` has arrival, kind (``monitor_add`` or ``monitor_delete``) and
    the columns of a monitor; they take effect in the order of arrival. A
    monitor sees what arrives after it was added, up to where it was deleted.
    ``held`` are those added before, ``taken`` the names of configured ones.
    """
    name_check = validate.check_monitor_name(F.col("name"))["valid"]
    pattern_check = validate.check_pattern(F.col("locking_script_pattern"))["valid"]
    columns = ["arrival", "kind", "name", "track_descendants", "address", "locking_script_pattern"]
    asked = events.select(*columns, name_check.alias("name_ok"), pattern_check.alias("pattern_ok")).collect()  # configuration
    now, refused = list(held), []
    resolved = with_patterns(spark, [Monitor(r["address"], address=r["address"]) for r in asked if r["address"] is not None], network)
    scripts = {m.name: m.locking_script_pattern for m in resolved}
    for r in sorted(asked, key=lambda r: (r["arrival"], r["kind"], r["name"] or "")):
        live = {m.name: i for i, m in enumerate(now) if m.valid_to is None}
        adds, name, reason = r["kind"] == "monitor_add", r["name"], None
        pattern = r["locking_script_pattern"] if r["address"] is None else scripts.get(r["address"])
        if not r["name_ok"]:
            reason = "bad name"
        elif adds and r["locking_script_pattern"] is not None and not r["pattern_ok"]:
            reason = "bad pattern"
        elif adds and r["address"] is None and pattern is None:
            reason = "neither address nor pattern"
        elif adds and (name in live or name in taken):
            reason = "name in use"
        elif adds and pattern is None:
            reason = "bad address"
        elif not adds and name not in live:
            reason = "not dynamic" if name in taken else "unknown name"
        if reason:
            refused.append((r["arrival"], r["kind"], name, reason))
        elif adds:
            now.append(Monitor(name, bool(r["track_descendants"]), None, pattern, r["arrival"]))
        else:
            now[live[name]] = replace(now[live[name]], valid_to=r["arrival"])
    return now, refused


def monitor_order(static: DataFrame, dynamic: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """All monitors in the order they are tried, with their priority.

    Each input has (position, name, ...). Static monitors come first, then the
    dynamic ones known at start, then ``broadcast``, then those added later.
    Monitors with neither address nor pattern are rejected.
    """
    columns = ["name", "track_descendants", "address", "locking_script_pattern"]
    usable = F.col("address").isNotNull() | F.col("locking_script_pattern").isNotNull()

    def part(df: DataFrame, stage: int) -> DataFrame:
        return df.filter(usable).select(F.lit(stage).alias("stage"), "position", *columns)

    spark = static.sparkSession
    last = spark.range(1).select(
        F.lit(2).alias("stage"),
        F.lit(0).cast(static.schema["position"].dataType).alias("position"),
        F.lit(BROADCAST).alias("name"),
        F.lit(False).alias("track_descendants"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("locking_script_pattern"),
    )
    parts = [part(static, 0), part(dynamic, 1), last] + ([part(added, 3)] if added is not None else [])
    return reduce(DataFrame.unionByName, parts)


def check_monitors(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Verdict on each new monitor: (name, valid, reason).

    A name may be used once, so of several candidates with one name only the
    first by ``position`` passes.
    """
    taken = existing.select("name").distinct().withColumn("_taken", F.lit(True))
    usable = F.col("address").isNotNull() | F.col("locking_script_pattern").isNotNull()
    name_check = validate.check_monitor_name(F.col("name"))
    pattern_check = validate.check_pattern(F.col("locking_script_pattern"))
    judged = candidates.join(taken, "name", "left").withColumn(
        "reason",
        F.when(~name_check["valid"], "bad name")
        .when(F.col("locking_script_pattern").isNotNull() & ~pattern_check["valid"], "bad pattern")
        .when(~usable, "neither address nor pattern")
        .when(F.col("_taken"), "name in use"),
    )
    first = (
        judged.filter(F.col("reason").isNull())
        .groupBy("name")
        .agg(F.min("position").alias("_first"))
    )
    verdict = F.coalesce("reason", F.when(F.col("position") != F.col("_first"), "name in use"))
    return (
        judged.join(first, "name", "left")
        .select("position", "name", verdict.alias("reason"))
        .withColumn("valid", F.col("reason").isNull())
    )


def check_deletes(names: DataFrame, static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Verdict on each name to delete: only dynamic monitors can go."""
    known = static.select("name", F.lit(False).alias("_dynamic")).unionByName(
        dynamic.select("name", F.lit(True).alias("_dynamic"))
    )
    state = known.groupBy("name").agg(F.max("_dynamic").alias("_dynamic"))
    name_check = validate.check_monitor_name(F.col("name"))
    reason = (
        F.when(~name_check["valid"], "bad name")
        .when(F.col("_dynamic").isNull(), "unknown name")
        .when(~F.col("_dynamic"), "not dynamic")
    )
    return (
        names.join(state, "name", "left")
        .select(*names.columns, reason.alias("reason"))
        .withColumn("valid", F.col("reason").isNull())
    )


def _arrival(df: DataFrame) -> str:
    return "at" if "at" in df.columns else "seq"


def _active(m: Monitor, at: str) -> Column:
    if m.valid_from is None and m.valid_to is None:
        return F.lit(True)
    return F.col(at).between(m.valid_from or 0, (m.valid_to or FOREVER) - 1)


def _matches(outputs: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """(hash, priority) of every output script and monitor that matches it."""
    usable = [(i, m) for i, m in enumerate(monitors) if m.locking_script_pattern is not None]
    exact = [(i, m) for i, m in usable if re.fullmatch(ADDRESS_SCRIPT, m.locking_script_pattern)]
    plain = {i for i, _ in exact}
    others = [(i, m) for i, m in usable if i not in plain]
    indexed = [(i, m) for i, m in others if required_run(m.locking_script_pattern)] if len(others) > FEW_PATTERNS else []
    shared = {i for i, _ in indexed}
    hits = [
        F.when(F.col("script_hex").rlike(m.locking_script_pattern) & _active(m, _arrival(outputs)), F.lit(i))
        for i, m in others
        if i not in shared
    ]
    found = outputs.select("hash", F.explode(F.array_compact(F.array(*hits, F.lit(None).cast("int")))).alias("priority"))
    if indexed:
        rules = [(i, m.locking_script_pattern, m.valid_from or 0, (m.valid_to or FOREVER) - 1) for i, m in indexed]
        timed = any(m.valid_from is not None or m.valid_to is not None for _, m in indexed)
        at = F.col(_arrival(outputs)) if timed else F.lit(0).cast("long")
        found = found.unionByName(indexed_matches(outputs, rules, at))
    if not exact:
        return found
    rows = [(m.locking_script_pattern, i, m.valid_from or 0, (m.valid_to or FOREVER) - 1) for i, m in exact]
    table = outputs.sparkSession.createDataFrame(rows, "script string, priority int, since long, until long")
    timed = any(m.valid_from is not None or m.valid_to is not None for _, m in exact)
    scripts = F.array_distinct(F.regexp_extract_all("script_hex", F.lit(f"(?=({ADDRESS_SCRIPT}))"), F.lit(1)))
    seq = F.col(_arrival(outputs)) if timed else F.lit(0).cast("long")
    held = outputs.select("hash", seq.alias("seq"), F.explode(scripts).alias("script"))
    joined = held.join(table, "script").filter(F.col("seq").between(F.col("since"), F.col("until")))
    return found.unionByName(joined.select("hash", "priority"))


def pattern_matches(outputs: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """(hash, name) of each transaction with an output script a monitor matches."""
    named = F.array(*[F.lit(m.name) for m in monitors])
    return _matches(outputs, monitors).distinct().select("hash", F.get(named, F.col("priority")).alias("name"))


def own_matches(outputs: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """(hash, priority): the first monitor that matches an output script."""
    return _matches(outputs, monitors).groupBy("hash").agg(F.min("priority").alias("priority"))


def direct_descendants(inputs: DataFrame, captured: DataFrame) -> DataFrame:
    """Transactions that spend from a captured one.

    The parents are written first: both sides of the join are then plain
    shuffles, and Spark splits a parent that is spent by very many.
    """
    parents = materialize(captured.select(F.col("hash").alias("prev_hash")).distinct(), "parents")
    return inputs.join(parents, "prev_hash", "left_semi").select("hash").distinct()


def _passing(monitors: list[Monitor]) -> Passing:
    def span(m: Monitor) -> tuple[int, int] | None:
        if not m.track_descendants:
            return None
        if m.valid_from is None and m.valid_to is None:
            return -LONGEST, LONGEST
        return m.valid_from or 0, (m.valid_to or FOREVER) - 1

    return Passing([span(m) for m in monitors])


def assign(
    txs: DataFrame, inputs: DataFrame, matches: DataFrame, monitors: list[Monitor], generations: int = GENERATIONS
) -> DataFrame:
    """(hash, priority): the one collection of each captured transaction.

    A transaction goes to the first monitor that matches it or, for monitors
    that track descendants, holds one of its parents; only parents that
    arrived before count. A change of a parent can take a transaction away
    from a later monitor, so children of changed transactions are judged
    again until nothing changes.

    Edges carry what parent and child match on their own, so a round joins
    them only with the transactions that changed; its result is appended to a
    log, from which the newest row per hash counts. A round is a generation;
    what still changes after ``generations`` of them is worked out by
    ``descent.settle``, whose rounds skip whole chains.
    """
    tracking = [i for i, m in enumerate(monitors) if m.track_descendants]
    if not tracking:
        return matches.select("hash", "priority")
    spark = txs.sparkSession
    matches = matches.select("hash", "priority")
    own = matches.select("hash", F.col("priority").alias("own"))
    parent = txs.select("hash", F.col("seq").alias("prev_seq")).join(own, "hash", "left")
    parent = parent.select(F.col("hash").alias("prev_hash"), "prev_seq", F.col("own").alias("prev_own"))
    extra = [c for c in inputs.columns if c == "at"]
    links = inputs.select("hash", "prev_hash", "seq", *extra).distinct().join(parent, "prev_hash")
    edges = materialize(links.filter("prev_seq < seq").drop("prev_seq").join(own, "hash", "left"), "edges")
    timed = [i for i in tracking if monitors[i].valid_from is not None or monitors[i].valid_to is not None]
    always = F.col("priority").isin([i for i in tracking if i not in timed])
    passes_on = reduce(lambda c, i: c | ((F.col("priority") == i) & _active(monitors[i], _arrival(inputs))), timed, always)
    folder = new_path(spark, "assigned")
    schema = f"hash {txs.schema['hash'].dataType.simpleString()}, priority int, before int"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/round=0")
    changed = matches.filter(F.col("priority").isin(tracking)).select(F.col("hash").alias("prev_hash"))
    step = 0
    while True:
        if step == generations:
            passing = _passing(monitors)
            epoch = passing.epoch(F.col(_arrival(inputs))).alias("epoch")
            held = settle(edges.select("hash", "prev_hash", epoch), own, passing)
            alone = matches.join(edges.select("hash").distinct(), "hash", "left_anti")
            return alone.unionByName(held.filter("priority is not null"))
        step += 1
        log = spark.read.schema(schema + ", round int").parquet(folder)
        # A row means the hash is not in its own collection any more.
        newest = log.groupBy("hash").agg(F.max_by(F.struct("priority"), "round").alias("newest"))
        touched = edges.join(changed, "prev_hash", "left_semi").select("hash").distinct()
        of_parent = newest.select(F.col("hash").alias("prev_hash"), F.col("newest").alias("prev_newest"))
        held = F.when(F.col("prev_newest").isNotNull(), F.col("prev_newest.priority")).otherwise(F.col("prev_own"))
        judged = (
            edges.join(touched, "hash", "left_semi")
            .join(of_parent, "prev_hash", "left")
            .withColumn("priority", held)
            .groupBy("hash")
            .agg(F.min("own").alias("own"), F.min(F.when(passes_on, F.col("priority"))).alias("inherited"))
            .join(newest, "hash", "left")
            .select(
                "hash",
                F.least("own", "inherited").alias("priority"),
                F.when(F.col("newest").isNotNull(), F.col("newest.priority")).otherwise(F.col("own")).alias("before"),
            )
            .filter(~F.col("priority").eqNullSafe(F.col("before")))
        )
        path = f"{folder}/round={step}"
        compact_writer(judged).parquet(path)
        delta = spark.read.schema(schema).parquet(path)
        moved = delta.filter(F.col("priority").isin(tracking) | F.col("before").isin(tracking))
        if moved.isEmpty():
            break
        changed = moved.select(F.col("hash").alias("prev_hash"))
    log = spark.read.schema(schema + ", round int").parquet(folder)
    newest = log.groupBy("hash").agg(F.max_by("priority", "round").alias("priority"))
    kept = matches.join(newest.select("hash"), "hash", "left_anti")
    return kept.unionByName(newest.filter("priority is not null"))


def capture(txs: DataFrame, assigned: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """(hash, name) rows of the collection table.

    A locally submitted transaction that no monitor took goes to ``broadcast``.
    """
    named = F.array(*[F.lit(m.name) for m in monitors]).cast("array<string>")
    taken = txs.select("hash", "submitted").join(assigned, "hash", "left")
    name = F.coalesce(F.get(named, F.col("priority")), F.when(F.col("submitted"), F.lit(BROADCAST)))
    return taken.select("hash", name.alias("name")).filter("name is not null")
