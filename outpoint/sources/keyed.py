"""Tables with a key: changes are appended and merged when read, lookups read only files that can have their keys.

A change writes a folder of its own, of the size of the change: rows that
replace those of their key, or keys whose rows go. A manifest names the
folders that count, in order. It is a small file per version that appears
under its name at once, so a reader sees the table before or after a change,
and what a failed change has written is never named. ``compact`` writes the
merged rows as one folder and starts a new list; ``vacuum`` removes what no
manifest that is kept names.

A log appends rows as they come, with the number of their batch. A batch that
runs again replaces what it has appended. Where the other columns are ``summed``,
rows are changes of an amount per key, and merging adds them up. ``settle`` merges parts of about one
size, eight at a time, so a row is written again once per power of eight and a
lookup meets few parts however long the history is.

Rows are sorted by key over the files of a folder. Beside each such folder lies an
index with the least and greatest value per file and cell (the first two
characters of a text, a range of whole numbers) of every key column. A lookup
joins its keys with the index and opens the files that come out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import restored, short, text_columns, unpacked
from ..operators.maintenance import delete_keys, matching
from ..session import compact_writer, materialize

# Whole numbers that share a cell of the index.
RANGE = 10_000
#: With this many times as many keys as files nearly every file has one, and the index is not asked.
MANY = 4
#: Parts of one level that are merged into one of the next.
MERGED = 8
#: A table is due for compaction when its changes have more than this share of its rows.
DUE = 0.25


class ConcurrentChange(RuntimeError):
    """Somebody else has changed the table since its manifest was read."""


def _cell(column: Column, kind: str) -> Column:
    return F.substring(column, 1, 2) if kind == "string" else F.floor(column / RANGE).cast("string")


class KeyedTable:
    """A table in one folder with at most one row per key; key columns are never null."""

    def __init__(self, spark: SparkSession, folder: str, ddl: str, keys: list[str], summed: bool = False):
        self.spark, self.folder, self.ddl, self.keys = spark, folder.rstrip("/"), ddl, keys
        self.summed = summed
        self.kinds = dict(c.split() for c in ddl.split(", "))
        self.columns = list(self.kinds)

    # Manifests

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _manifest_path(self, version: int) -> str:
        return f"{self.folder}/_manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        place, system = self._place(f"{self.folder}/_manifest")
        if not system.exists(place):
            return []
        names = [f.getPath().getName() for f in system.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``version`` and ``parts`` of the newest or a given version; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "parts": []}
        place, system = self._place(self._manifest_path(version))
        stream = system.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, base: dict, parts: list[dict]) -> int:
        """Make ``parts`` the next version after ``base``."""
        version = base["version"] + 1
        target, system = self._place(self._manifest_path(version))
        draft, _ = self._place(f"{self.folder}/_manifest/draft-{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
        out.close()
        if system.exists(target) or not system.rename(draft, target):
            system.delete(draft, False)
            raise ConcurrentChange(self.folder)
        return version

    # Changes

    def _write(self, rows: DataFrame, kind: str, on: list[str], turn: int) -> dict | None:
        """A folder with ``rows`` and its index; None without rows. Rows that have a turn keep it."""
        name = f"{kind}-{turn:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{name}"
        turned = rows if "_turn" in rows.columns else rows.withColumn("_turn", F.lit(turn).cast("long"))
        by = [unpacked(F.col(c)) if self.kinds[c] == "string" else F.col(c) for c in on]
        ranged = restored(short(turned).repartitionByRange(*by), turned).sortWithinPartitions(*on)
        writer = compact_writer(ranged).option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as its file needs
        for column in on:
            if self.kinds[column] == "string":
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                writer = writer.option(f"parquet.bloom.filter.candidates.number#{column}", "10")  # down to 2 KB
        writer.parquet(path)
        indexed = [c for c in on if c in self.keys]
        stored = self.spark.read.schema(self._ddl([c for c in rows.columns if c != "_turn"])).parquet(path)
        stored = stored.select(F.col("_metadata.file_name").alias("file"), *on)
        stats = [
            stored.groupBy("file", F.lit(c).alias("column"), _cell(F.col(c), self.kinds[c]).alias("cell")).agg(
                F.min(c).cast("string").alias("first"), F.max(c).cast("string").alias("last"), F.count(F.lit(1)).alias("rows")
            )
            for c in indexed
        ] or [stored.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))]
        index = f"{self.folder}/_index/{name}"
        reduce(DataFrame.unionByName, stats).write.parquet(index)
        found = self.spark.read.parquet(index)
        if indexed:
            found = found.filter(F.col("column") == indexed[0])
        size = found.agg(F.sum("rows"), F.countDistinct("file")).first()
        return {"path": name, "kind": kind, "on": on, "turn": turn, "rows": size[0], "files": size[1]} if size[0] else None

    def _ddl(self, columns: list[str]) -> str:
        return ", ".join(f"{c} {self.kinds[c]}" for c in columns) + ", _turn bigint"

    def append(self, rows: DataFrame, batch: int) -> DataFrame:
        """Add the rows of a batch to a log, instead of what this and later batches have added before; they come back.

        Nothing is looked up or sorted; the folder has the size of the batch.
        """
        base = self.manifest()
        name = f"rows-{base['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{name}"
        compact_writer(rows.select(*self.columns, F.lit(batch).cast("long").alias("_turn"))).parquet(path)
        written = self.spark.read.schema(self.ddl + ", _turn bigint").parquet(path)
        parts = [p for p in base["parts"] if p["batch"] < batch]
        count = written.count()
        if count:
            parts.append({"path": name, "kind": "rows", "on": [], "turn": batch, "rows": count, "files": None, "batch": batch, "level": 0})
        if parts != base["parts"]:
            self._publish(base, parts)
        return written.drop("_turn")

    def forget(self, keys: DataFrame, on: list[str], batch: int) -> None:
        """Rows of a log that this and earlier batches have written go, if their ``on`` (any columns) is in ``keys``.

        Only these values are written. It comes after the rows of its batch: when that runs again, ``append`` takes it back.
        """
        base = self.manifest()
        part = self._write(keys.select(*[F.col(c).cast(self.kinds[c]).alias(c) for c in on]).distinct(), "gone", on, batch)
        if part:
            self._publish(base, [*base["parts"], part | {"batch": batch, "level": None}])

    def settle(self, before: int) -> None:
        """Merge parts of a log, all of batches that will not run again, wherever a level has ``MERGED`` of them."""
        base = self.manifest()
        parts, changed = base["parts"], False
        while True:
            levels: dict[int, list[dict]] = {}
            for p in parts:
                if p["batch"] < before and p["kind"] == "rows":
                    levels.setdefault(p["level"], []).append(p)
            full = min((k for k, found in levels.items() if len(found) >= MERGED), default=None)
            if full is None:
                break
            old = levels[full]
            rows = reduce(DataFrame.unionByName, self._frames(old))
            last = max(p["batch"] for p in old)
            if self.summed:
                rows = self.added_up(rows).withColumn("_turn", F.lit(last).cast("long"))
            merged = self._write(rows, "rows", self.keys, last)
            at = parts.index(old[0])
            parts = [p for p in parts if p not in old]
            if merged:
                parts.insert(at, merged | {"batch": last, "level": full + 1})
            changed = True
        if changed:
            self._publish(base, parts)

    def added_up(self, rows: DataFrame) -> DataFrame:
        """One row per key, none where all sums are 0."""
        amounts = [c for c in self.columns if c not in self.keys]
        sums = rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in amounts])
        return sums.filter(reduce(Column.__or__, [F.col(c) != 0 for c in amounts]))

    def _log(self, before: int | None) -> tuple[list[dict], list[dict]]:
        """Parts with rows, and those with what is forgotten."""
        manifest = self.manifest()
        return self._split({"parts": [p for p in manifest["parts"] if before is None or p["batch"] < before]})

    def log_parts(self, before: int | None = None) -> list[dict]:
        return self._log(before)[0]

    def _remembered(self, frames: list[DataFrame], gone: list[dict]) -> DataFrame:
        if not frames:
            return self.spark.createDataFrame([], self.ddl)
        return self._without(reduce(DataFrame.unionByName, frames), gone).select(*self.columns)

    def logged(self, before: int | None = None) -> DataFrame:
        """All rows of a log, or those of batches before one."""
        parts, gone = self._log(before)
        return self._remembered(self._frames(parts), gone)

    def backwards(self, before: int | None = None) -> Iterator[DataFrame]:
        """Rows of each part, the last one first."""
        parts, gone = self._log(before)
        for part in reversed(parts):
            yield self._remembered(self._frames([part]), gone)

    def logged_of(self, keys: DataFrame, on: str, before: int | None = None) -> DataFrame:
        """Rows of a log whose key column ``on`` is in ``keys``, from recent parts and from the files that can have them."""
        parts, gone = self._log(before)
        recent, settled = [p for p in parts if not p["level"]], [p for p in parts if p["level"]]
        wanted = keys.filter(F.col(on).isNotNull()).select(F.col(on).cast(self.kinds[on]).alias(on)).distinct()
        frames = self._frames(recent)
        if settled:
            wanted = materialize(wanted, "asked")
            frames += self._frames(settled, self._files_of(wanted, on, settled))
        if not frames:
            return self.spark.createDataFrame([], self.ddl)
        return self._remembered([matching(reduce(DataFrame.unionByName, frames), wanted, [on])], gone)

    def _change(self, rows: DataFrame, kind: str, on: list[str]) -> int:
        base = self.manifest()
        part = self._write(rows, kind, on, base["version"] + 1)
        return self._publish(base, [*base["parts"], part]) if part else base["version"]

    def upsert(self, delta: DataFrame, order: str | None = None) -> int:
        """Put the newest row of each key in ``delta``, by ``order``, in place of its row; the new version comes back.

        Without ``order`` the keys of ``delta`` are unique.
        """
        if order is None:
            return self._change(delta.select(*self.columns), "rows", self.keys)
        rest = [c for c in self.columns if c not in self.keys]
        newest = delta.groupBy(*self.keys).agg(F.max(F.struct(F.col(order).alias("_order"), *rest)).alias("_newest"))
        return self._change(newest.select(*[c if c in self.keys else F.col(f"_newest.{c}").alias(c) for c in self.columns]), "rows", self.keys)

    def insert_once(self, delta: DataFrame, order: list[str]) -> int:
        """Add the rows whose key is new, the first of each by ``order``.

        ``delta`` is read twice, for its keys and for its rows. Rows of known
        keys go first, and the others stay where the join has put them: texts
        are packed and move once.
        """
        rest = [c for c in self.columns if c not in self.keys]
        asked = delta.select(*self.columns, *[c for c in order if c not in self.columns])
        texts = set(text_columns(asked))

        def shown(name: str) -> Column:
            return unpacked(F.col(name)) if name in texts else F.col(name)

        known = self.find(delta, self.keys[0]).select(*self.keys)
        fresh = delete_keys(short(asked), short(known), self.keys)
        first = F.min(F.struct(*[shown(c).alias(f"_order{i}") for i, c in enumerate(order)], *[shown(c).alias(c) for c in rest]))
        once = fresh.groupBy(*self.keys).agg(first.alias("_first")) if rest or order else fresh.distinct()
        rows = once.select(*[shown(c).alias(c) if c in self.keys else F.col(f"_first.{c}").alias(c) for c in self.columns])
        return self._change(rows, "rows", self.keys)

    def delete(self, keys: DataFrame, on: list[str]) -> int:
        """Delete the rows whose ``on`` (any columns) is in ``keys``. Only these values are written."""
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
        return self._change(keys.filter(known).select(*[F.col(c).cast(self.kinds[c]).alias(c) for c in on]).distinct(), "gone", on)

    # Reading

    def _frames(self, parts: list[dict], files: dict[str, list[str]] | None = None) -> list[DataFrame]:
        """Rows of each part, of the given files only."""
        reader = self.spark.read.schema(self.ddl + ", _turn bigint")
        out = []
        for part in parts:
            path = f"{self.folder}/{part['path']}"
            if files is None:
                out.append(reader.parquet(path))
            elif files.get(part["path"]):
                out.append(reader.parquet(*[f"{path}/{f}" for f in files[part["path"]]]))
        return out

    def _without(self, rows: DataFrame, gone: list[dict]) -> DataFrame:
        """Rows that no part of ``gone`` has removed after they were written."""
        by_columns: dict[tuple, list[str]] = {}
        for part in gone:
            by_columns.setdefault(tuple(part["on"]), []).append(f"{self.folder}/{part['path']}")
        for on, paths in by_columns.items():
            keys = self.spark.read.schema(self._ddl(list(on))).parquet(*paths)
            until = keys.groupBy(*on).agg(F.max("_turn").alias("_until"))
            rows = rows.join(until, list(on), "left").filter(F.col("_until").isNull() | (F.col("_turn") > F.col("_until"))).drop("_until")
        return rows

    def _merged(self, frames: list[DataFrame], gone: list[dict]) -> DataFrame:
        """The rows that count: the newest of each key, if it was not deleted later."""
        if not frames:
            return self.spark.createDataFrame([], self.ddl)
        rows = frames[0]
        if len(frames) > 1:
            rest = [c for c in [*self.columns, "_turn"] if c not in self.keys]
            newest = F.max(F.struct("_turn", *[c for c in rest if c != "_turn"])).alias("_newest")
            later = reduce(DataFrame.unionByName, frames[1:]).groupBy(*self.keys).agg(newest)
            later = later.select(*self.keys, *[F.col(f"_newest.{c}").alias(c) for c in rest])
            # The large part is not aggregated: it loses the keys that have newer rows.
            rows = delete_keys(rows, later, self.keys).unionByName(later.select(*rows.columns))
        return self._without(rows, gone).select(*self.columns)

    @staticmethod
    def _split(manifest: dict) -> tuple[list[dict], list[dict]]:
        parts = manifest["parts"]
        return [p for p in parts if p["kind"] == "rows"], [p for p in parts if p["kind"] == "gone"]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, now or as of a version that was not vacuumed."""
        parts, gone = self._split(self.manifest(version))
        return self._merged(self._frames(parts), gone)

    def added(self, since: int) -> DataFrame:
        """Rows that changes after version ``since`` have written, as far as they count."""
        parts, gone = self._split(self.manifest())
        return self._merged(self._frames([p for p in parts if p["turn"] > since]), gone)

    def candidates(self, wanted: DataFrame, on: str, parts: list[dict]) -> dict[str, list[str]]:
        """Files of each part that can have a value of ``wanted`` in the key column ``on``."""
        if not parts:
            return {}
        kind = self.kinds[on]
        asked = wanted.select(F.col(on).alias("_key"), _cell(F.col(on), kind).alias("cell"))
        index = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/_index/{p['path']}").withColumn("part", F.lit(p["path"])) for p in parts])
        index = index.filter(F.col("column") == on)
        within = F.col("_key").between(F.col("first").cast(kind), F.col("last").cast(kind))
        hits = index.join(asked, "cell").filter(within).select("part", "file").distinct()
        files: dict[str, list[str]] = {}
        for row in hits.collect():  # names of files
            files.setdefault(row["part"], []).append(row["file"])
        return files

    def _files_of(self, wanted: DataFrame, on: str, parts: list[dict]) -> dict[str, list[str]] | None:
        """The candidates, or None for all files where there are keys for nearly all of them."""
        if wanted.count() >= MANY * sum(p["files"] for p in parts):
            return None
        return self.candidates(wanted, on, parts)

    def find(self, keys: DataFrame, on: str, unique: bool = False) -> DataFrame:
        """Rows whose key column ``on`` is in ``keys``; other files than theirs are not opened.

        All versions of a row have the same key, so no file that matters is
        left out. ``unique`` says that the keys are distinct and stand in a
        table; otherwise they are written first.
        """
        wanted = self._wanted(keys, on)
        wanted = wanted if unique else materialize(restored(short(wanted).distinct(), wanted), "asked")
        parts, gone = self._split(self.manifest())
        files = self._files_of(wanted, on, parts)
        found = [restored(matching(short(f), short(wanted), [on]), f) for f in self._frames(parts, files)]
        return self._merged(found, gone)

    def near(self, keys: DataFrame, on: str) -> DataFrame:
        """Rows of the files that can have a value of ``keys`` in the key column ``on``: those ``find`` gives and others.

        For an answer that joins them with the keys itself. ``keys`` are
        distinct and stand in a table.
        """
        parts, gone = self._split(self.manifest())
        return self._merged(self._frames(parts, self._files_of(self._wanted(keys, on), on, parts)), gone)

    def _wanted(self, keys: DataFrame, on: str) -> DataFrame:
        if on not in self.keys:
            raise ValueError(f"{on} is no key column of {self.folder}")
        return keys.filter(F.col(on).isNotNull()).select(F.col(on).cast(self.kinds[on]).alias(on))

    # Upkeep

    def due(self) -> bool:
        """Whether the changes have grown so large against the first part that merging costs more than compacting."""
        parts = self.manifest()["parts"]
        return len(parts) > 1 and sum(p["rows"] for p in parts[1:]) > DUE * parts[0]["rows"]

    def compact(self) -> int:
        """Write the merged rows as one part; older versions can be read until ``vacuum``."""
        base = self.manifest()
        part = self._write(self.read(base["version"]), "rows", self.keys, base["version"] + 1)
        return self._publish(base, [part] if part else [])

    def vacuum(self, keep: int = 1) -> None:
        """Remove manifests but the newest ``keep``, and the folders that none of these names."""
        kept = self.versions()[-keep:]
        named = {p["path"] for v in kept for p in self.manifest(v)["parts"]}
        for version in self.versions():
            if version not in kept:
                place, system = self._place(self._manifest_path(version))
                system.delete(place, False)
        for top in ("", "/_index"):
            place, system = self._place(f"{self.folder}{top}")
            for status in system.listStatus(place) if system.exists(place) else []:
                name = status.getPath().getName()
                if name.split("-")[0] in ("rows", "gone") and name not in named:
                    system.delete(status.getPath(), True)
