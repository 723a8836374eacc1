"""Fuzzy line deduplication over all documents.

A line is what stands between line feeds, without white space around it; blank
lines are left alone. Lines are compared by their character shingles (six
characters, A-Z lower-cased; a shorter line is one shingle) and are the same
line at a Jaccard similarity of 0.8 or more.

MinHash signatures of long lines come from one pass over the shingles: a hash
chooses a bin and competes there for the minimum; the few empty bins borrow
from the next filled one. Lines with few shingles would leave many bins empty,
so each of their values is the minimum of an own hash; lines in between get
both. Sixteen bands of five values find 99.8 % of pairs at 0.8 and more above
it. Banding keys travel in packed inverted lists; candidates are checked
exactly, and a distributed union-find makes components. Of each component the
first line stays, by doc_id and place; all others go. Equal lines (by a 64-bit
hash) need no check, and a task signs a line once however often it meets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lists
from . import textbytes as tb
from .common import bounded_batches, map_batches, table, written

CHARS = 6
#: Similarity of 4/5 or more.
LEAST, OF = 4, 5
BANDS, VALUES = 16, 5
BINS = BANDS * VALUES
#: Lines that fill fewer bins get an own hash per value, those that fill more get bins. At a
#: similarity of 0.8 a line on one side and a line on the other side of the gap are not to be expected.
FEW, MANY = 60, 72
#: Bytes of a line that are signed at once (a line that is longer is alone).
BLOCK = 1 << 17
#: Hashes of lines that a task has signed and remembers.
REMEMBERED = 1 << 17
#: Characters of white space at an end of a line that are taken off one by one, for all lines at once.
TRIM_STEPS = 16

_U = np.uint64
_FEED = 10


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, start and end of all lines that are not blank, without white space around them."""
    breaks = np.flatnonzero(data == _FEED)
    starts = np.concatenate([at[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.minimum(np.append(starts[1:] - 1, at[-1]), at[rows + 1])
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends = np.where(last, at[rows + 1], ends)
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    starts, ends = _trimmed(data, starts, ends)
    full = starts < ends
    return rows[full], place[full], starts[full], ends[full]


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space around them; a span of nothing else ends where it starts."""
    starts, ends = starts.copy(), ends.copy()
    for edge, other, before, by in ((starts, ends, 0, 1), (ends, starts, 1, -1)):
        left = np.flatnonzero(starts < ends)
        for _ in range(TRIM_STEPS):
            left = left[tb._SPACE[data[edge[left] - before]]]
            if not len(left):
                break
            edge[left] += by
            left = left[edge[left] != other[left]]
        for i in left.tolist():  # long white space
            solid = np.flatnonzero(~tb._SPACE[data[starts[i] : ends[i]]])
            starts[i], ends[i] = (starts[i] + solid[0], starts[i] + solid[-1] + 1) if len(solid) else (starts[i], starts[i])
    return starts, ends


def line_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each line, A-Z lower-cased, block by block."""
    out = np.zeros(len(starts), np.int64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + tb.BLOCK, "right")))
        part = data[starts[i] : ends[j - 1]]
        out[i:j] = tb.span_hashes(part, starts[i:j] - starts[i], ends[i:j] - starts[i]).view(np.int64)
        i = j
    return out


def char_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of each character shingle, A-Z lower-cased."""
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = b"\n".join(lines).lower()  # bytes.lower() changes A-Z alone; a line has no line feed
    if low.isascii():
        code = np.frombuffer(low, np.uint8)
    else:
        code = np.frombuffer(low.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    feeds = np.flatnonzero(code == _FEED)
    starts = np.append(0, feeds + 1)
    lengths = np.append(feeds, len(code)) - starts
    code = code.astype(np.uint64)
    code += _U(1)
    size = max(0, len(code) - CHARS + 1)
    every, each = np.zeros(size, np.uint64), np.empty(size, np.uint64)
    for k in range(CHARS):
        every += np.multiply(code[k : k + size], tb.STEPS[32 + k], out=each)
    whole = np.ones(len(every), bool)
    for k in range(CHARS):
        at = feeds - k
        whole[at[(at >= 0) & (at < len(every))]] = False
    line = np.repeat(np.arange(len(lines)), np.maximum(lengths - CHARS + 1, 0))
    short = np.flatnonzero((lengths > 0) & (lengths < CHARS))
    part = lengths[short].astype(np.uint64) * tb.STEPS[40]
    for k in range(CHARS - 1):
        has = lengths[short] > k
        part[has] += code[starts[short[has]] + k] * tb.STEPS[32 + k]
    return np.concatenate([line, short]), tb.mixed(np.concatenate([every[whole], part]))


_OWN = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, BINS, dtype=np.uint64) * _U(2) + _U(1)


def _few_minima(rows: np.ndarray, hashes: np.ndarray, lines: int) -> np.ndarray:
    """Lines by values, each the minimum of an own hash."""
    low = np.zeros((BINS, lines), np.uint64)
    order = np.argsort(rows, kind="stable")
    rows, hashes = rows[order], hashes[order]
    each = np.empty(len(hashes), np.uint64)
    at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    for k in range(BINS if len(rows) else 0):
        low[k, rows[at]] = np.minimum.reduceat(np.multiply(hashes, _OWN[k], out=each), at)
    return low.T >> _U(32)


def _binned_minima(rows: np.ndarray, hashes: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines by values, each the minimum of the hashes that fall into its bin, and how many bins those fill (from ``FEW`` on)."""
    empty = _U(1 << 32)
    low = np.full(lines * BINS, empty, np.uint64)
    bins = ((hashes >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    np.minimum.at(low, rows * BINS + bins, hashes & _U(0xFFFFFFFF))
    low = low.reshape(lines, BINS)
    filled = low != empty
    counts = filled.sum(1)
    # Every empty bin takes the value of the next filled one, going around, and its distance.
    gaps = np.flatnonzero((counts >= FEW) & (counts < BINS))
    if len(gaps):
        place = np.where(filled[gaps], np.arange(BINS), 2 * BINS)
        around = np.concatenate([place, place + BINS], axis=1)
        following = np.minimum.accumulate(around[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        far = (following - np.arange(BINS)).astype(np.uint64)
        low[gaps] = np.take_along_axis(low[gaps], following % BINS, axis=1) + far * tb.STEPS[41]
    return low, counts


def band_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) for every banding key of the lines."""
    rows, hashes = char_shingles(lines)
    binned, filled = _binned_minima(rows, hashes, len(lines))
    found = []
    for tag, part in ((0, filled < MANY), (1, filled >= FEW)):
        at = np.flatnonzero(part)
        if not len(at):
            continue
        if tag:
            low = binned[at]
        else:
            number = np.cumsum(part) - 1
            use = part[rows]
            low = _few_minima(number[rows[use]], hashes[use], len(at))
        values = tb.mixed(low + _U(1)).reshape(len(at), BANDS, VALUES) * tb.STEPS[42 : 42 + VALUES]
        keys = values.sum(axis=2, dtype=np.uint64) + tb.STEPS[tag * BANDS : (tag + 1) * BANDS]
        found.append((np.repeat(at, BANDS), tb.mixed(keys).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _places(batch: pa.RecordBatch) -> dict:
    """A row per line."""
    data, at = tb.string_parts(batch.column(1))
    rows, place, starts, ends = line_spans(data, at)
    doc_ids = batch.column(0).take(pa.array(rows))
    return {"doc_id": doc_ids, "place": pa.array(place.astype(np.int32)), "line": pa.array(line_ids(data, starts, ends))}


def _new_lines(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and bytes of lines that are new to the task (and may be wanted)."""
    seen: set[int] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = tb.string_parts(batch.column(0))
        _, _, starts, ends = line_spans(data, at)
        ids = line_ids(data, starts, ends)
        may = np.arange(len(ids)) if wanted is None else np.flatnonzero(lists.in_filter(wanted, ids))
        new = np.array([i for i, x in zip(may.tolist(), ids[may].tolist(), strict=True) if x not in seen and not seen.add(x)], np.int64)
        if len(seen) > REMEMBERED:
            seen.clear()
        raw, sizes = data.tobytes(), np.cumsum(ends[new] - starts[new])
        first = 0
        while first < len(new):
            last = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BLOCK)) + 1
            part = new[first:last]
            yield ids[part], [raw[lo:hi] for lo, hi in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            first = last


def _sign(buckets: int):
    """Packed banding keys of the lines that are new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            ids, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            return lists.pack(ids, np.zeros(len(ids), np.int64), keys, buckets)

        for ids, lines in _new_lines(batches):
            line, keys = band_keys(lines)
            held.append((ids[line], keys))
            size += len(keys)
            if size >= lists.SEND_KEYS:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return run


def _bodies(wanted: np.ndarray):
    """Lines that may be asked for, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lines in _new_lines(batches, wanted):
            bodies = pa.array([lists.packed_text(x) for x in lines], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), bodies], ["id", "body"])

    return run


def _shingles_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the sets of lines."""
    return tb.distinct_sorted(*char_shingles(lines))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, place, line) of every line that goes; place counts all lines of the text from 0.

    Rows without doc_id and null texts have none; other columns are ignored.
    Rows that repeat a doc_id are one document: a line that stays in one of
    them at some place stays in all at that place.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    every = written(map_batches(texts, _places, "doc_id long, place int, line long"), "lines")
    sent = texts.select("text").mapInArrow(_sign(lists.bucket_count(every.count() * BANDS)), lists.PACKED)

    def bodies(wanted: np.ndarray) -> DataFrame:
        return texts.select("text").mapInArrow(_bodies(wanted), "id long, body binary").dropDuplicates(["id"])

    parts = lists.list_components(sent, bodies, _shingles_of, LEAST, OF, sized=False)
    named = every.join(parts.select(F.col("node").alias("line"), "component"), "line", "left")
    named = written(named.select("doc_id", "place", "line", F.coalesce("component", "line").alias("group")), "groups")
    first = F.min(F.struct("doc_id", "place"))
    stay = named.groupBy("group").agg(first.alias("stay"), F.count("*").alias("n")).filter("n > 1")
    stay = written(stay.select("group", "stay"), "staying")
    return named.join(stay, "group").filter(F.struct("doc_id", "place") != F.col("stay")).select("doc_id", "place", "line")


def _without(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts without the lines in ``gone``, with the number of lines that are not blank and of those gone."""
    texts = batch.column(batch.schema.get_field_index("text"))
    gone = batch.column(batch.schema.get_field_index("gone"))
    data, at = tb.string_parts(texts)
    rows, place, starts, ends = line_spans(data, at)
    counts = np.bincount(rows, minlength=len(gone))
    # A line is found by its row and place; it goes if it is the line that was meant.
    drop, which = gone.flatten(), np.repeat(np.arange(len(gone)), gone.value_lengths().fill_null(0).to_numpy())
    asked = (which << 32) + drop.field("place").to_numpy().astype(np.int64)
    known = (rows << 32) + place
    found = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
    there = np.flatnonzero(known[found] == asked) if len(known) else np.zeros(0, np.int64)
    found, there = found[there], drop.field("line").to_numpy()[there]
    order = np.argsort(found, kind="stable")
    found, there = found[order], there[order]
    found = np.unique(found[line_ids(data, starts[found], ends[found]) == there])
    cuts = np.searchsorted(rows[found], np.arange(len(gone) + 1))
    out, places = texts.to_pylist(), place[found].tolist()
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        lose = set(places[cuts[r] : cuts[r + 1]])
        out[r] = "\n".join(line for p, line in enumerate(out[r].split("\n")) if p not in lose)
    return pa.array(out, texts.type), pa.array(counts.astype(np.int64)), pa.array(np.diff(cuts).astype(np.int64))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of ``text``, and two counts.

    ``n_lines`` are the text's lines that are not blank, ``n_dropped`` those
    taken out (columns of these names are replaced). Of equal or similar lines
    the first by (doc_id, place) stays, also within one document. Null texts
    stay null; rows without doc_id stay as they are; see ``repeated_lines``.
    """
    bounded_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    names = [f.name for f in fields]
    per_doc = repeated_lines(docs).groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list(F.struct("place", "line")).alias("gone"))
    per_doc = written(per_doc, "gone")
    others = [n for n in names if n != "text"]
    row = F.struct(*[F.col(f"`{n}`") for n in others]).alias("row")
    keyed = docs.select(row, F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("gone_id"))
    # Hashing the few lines of a document that go is cheaper than sorting texts.
    joined = keyed.join(per_doc.hint("shuffle_hash"), "gone_id", "left").select("row", "text", "gone")
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, lines, dropped = _without(batch)
            row = batch.column(0)
            columns = [text if n == "text" else row.field(others.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, lines, dropped], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; a document of which every line stands elsewhere goes."""
    found = dedup_lines(docs)
    kept = found.filter("text IS NULL OR n_lines = 0 OR n_dropped < n_lines")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_dropped")
