"""Fill-in-middle rearrangement with a learned index from token rank to text offset.

A token is white space and the word after it, or white space at the end. The
offsets of all token ends of a text are a rising function of the rank. It is
approximated by straight segments in whole numbers: a segment that misses some
offset by more than ``BOUND`` is halved, all segments of a batch at once, until
none does. What a segment misses by is kept as one signed byte per rank, so an
offset is the prediction of its segment plus the stored residual, exactly.

``rank_index`` keeps that index as a table, ``offset_at`` reads it with column
expressions; ``fill_in_middle`` builds it batch by batch, cuts with it and lets
it go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import bounded_batches, table

SEED = 42
#: Of 100 texts, how many stay plain, and of 100 others, how many put the suffix first.
PLAIN_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest residual, so that it fits a signed byte.
BOUND = 127

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def token_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets 0 and of every token end, text after text, and where each text's offsets begin.

    ``data`` are the bytes of all texts and ``at`` the bounds of each; the
    offsets count from the start of the text.
    """
    sizes = np.diff(at)
    stop = ~_SPACE[data]
    stop[:-1] &= _SPACE[data[1:]]  # the last byte of a word
    stop[at[1:][sizes > 0] - 1] = True  # the last byte of a text, white space or not
    ends = np.flatnonzero(stop) + 1
    counts = np.searchsorted(ends, at[1:], "right") - np.searchsorted(ends, at[:-1], "right")
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    offsets = np.zeros(starts[-1], np.int64)
    row = np.repeat(np.arange(len(sizes)), counts)
    offsets[np.arange(len(ends)) + row + 1] = ends - at[row]
    return offsets, starts


class RankIndex:
    """Segments over the offsets of several texts; rank r of text i is place ``starts[i] + r``."""

    def __init__(self, offsets: np.ndarray, starts: np.ndarray, bound: int = BOUND) -> None:
        self.starts = starts
        lo, hi = starts[:-1], starts[1:] - 1  # a segment goes through the offsets at both of its ends
        done: list[tuple[np.ndarray, np.ndarray]] = []
        residuals = np.zeros(len(offsets), np.int8)
        while len(lo):
            sizes = hi - lo + 1
            first = np.cumsum(sizes) - sizes
            each = np.repeat(np.arange(len(lo)), sizes)
            place = np.arange(int(sizes.sum())) - np.repeat(first - lo, sizes)
            missed = offsets[place] - self._line(place, lo[each], hi[each], offsets[lo][each], offsets[hi][each])
            worst = np.maximum.reduceat(np.abs(missed), first)
            good = worst <= bound
            kept = good[each]
            residuals[place[kept]] = missed[kept]
            done.append((lo[good], hi[good]))
            lo, hi = lo[~good], hi[~good]
            middle = (lo + hi) // 2
            lo, hi = np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])
        lo = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        hi = np.concatenate([d[1] for d in done]) if done else lo
        order = np.argsort(lo)
        self.lo, self.hi, self.residuals = lo[order], hi[order], residuals
        self.first, self.last = offsets[self.lo], offsets[self.hi]

    @staticmethod
    def _line(place, lo, hi, first, last) -> np.ndarray:
        return first + (place - lo) * (last - first) // np.maximum(hi - lo, 1)

    def offset(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Offset of each rank of each text: predicted by its segment, put right by its residual."""
        place = self.starts[text] + rank
        s = np.searchsorted(self.lo, place, "right") - 1
        return self._line(place, self.lo[s], self.hi[s], self.first[s], self.last[s]) + self.residuals[place]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = tb.string_parts(column)
    for first, last in tb.runs(at):
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]


INDEX = "id long, n long, segments array<struct<first_rank:long,last_rank:long,first_offset:long,last_offset:long>>, residuals binary"


def rank_index(docs: DataFrame, key: str = "doc_id", bound: int = BOUND) -> DataFrame:
    """(id, n, segments, residuals) of each text, a row per row; ranks 0 to ``n``, offsets in bytes.

    A null or empty text has n = 0, one segment and one residual.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in _blocks(batch.column(1)):
                index = RankIndex(*token_ends(data, at), bound)
                rows = []
                for i in range(last - first):
                    lo, hi = int(index.starts[i]), int(index.starts[i + 1])
                    mine = slice(*np.searchsorted(index.lo, [lo, hi]))
                    parts = zip(*(x[mine].tolist() for x in (index.lo - lo, index.hi - lo, index.first, index.last)), strict=True)
                    names = ("first_rank", "last_rank", "first_offset", "last_offset")
                    segments = [dict(zip(names, p, strict=True)) for p in parts]
                    rows.append({"n": hi - lo - 1, "segments": segments, "residuals": index.residuals[lo:hi].tobytes()})
                ids = batch.column(0).slice(first, last - first).to_pylist()
                yield pa.RecordBatch.from_pylist([{"id": k} | r for k, r in zip(ids, rows, strict=True)], ARROW_INDEX)

    return docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


ARROW_INDEX = pa.schema(
    [
        ("id", pa.int64()),
        ("n", pa.int64()),
        ("segments", pa.list_(pa.struct([(n, pa.int64()) for n in ("first_rank", "last_rank", "first_offset", "last_offset")]))),
        ("residuals", pa.binary()),
    ]
)


def offset_at(rank: Column, segments: str = "segments", residuals: str = "residuals") -> Column:
    """Byte offset of a rank from a stored index, as a column expression; null beyond the last rank."""
    s = F.get(F.filter(segments, lambda x: (x["first_rank"] <= rank) & (x["last_rank"] >= rank)), F.lit(0))
    width = F.greatest(s["last_rank"] - s["first_rank"], F.lit(1))
    scaled = (rank - s["first_rank"]) * (s["last_offset"] - s["first_offset"])
    line = s["first_offset"] + F.floor((scaled - F.pmod(scaled, width)) / width)
    byte = F.conv(F.hex(F.substring(residuals, rank.cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return line + F.when(byte > 127, byte - 256).otherwise(byte)


def draws(key: str = "doc_id", seed: int = SEED) -> list[Column]:
    """Four numbers h1 to h4 of a row from the hash of its key; null for null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def _arranged(column: pa.Array, h: list[np.ndarray], keyed: np.ndarray, bound: int) -> Iterator[dict]:
    """n, form, output and sizes in code points of the texts of a batch, block by block."""
    for first, last, data, at in _blocks(column):
        rows = last - first
        mine = slice(first, last)
        index = RankIndex(*token_ends(data, at), bound)
        n = np.diff(index.starts) - 1
        cuts = np.sort(np.stack([h[0][mine] % (n + 1), h[1][mine] % (n + 1)]), axis=0)
        each = np.arange(rows)
        one, two = index.offset(each, cuts[0]), index.offset(each, cuts[1])
        spm = h[3][mine] % 100 < SPM_PERCENT
        change = (n > 0) & (h[2][mine] % 100 < PLAIN_PERCENT) & keyed[mine]
        out: dict[str, list] = {"n": n.tolist(), "form": [], "output": [], "prefix_chars": [], "middle_chars": []}
        raw = data.tobytes()
        for i in range(rows):
            text = raw[at[i] : at[i + 1]]
            if not change[i] or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                form, made, sizes = "plain", text.decode(), (None, None)
            else:
                prefix, middle, suffix = (x.decode() for x in (text[: one[i]], text[one[i] : two[i]], text[two[i] :]))
                form, sizes = "spm" if spm[i] else "psm", (len(prefix), len(middle))
                pieces = [(PREFIX, prefix), (SUFFIX, suffix)]
                made = "".join(m + p for m, p in (pieces[::-1] if spm[i] else pieces)) + MIDDLE + middle
            for name, value in zip(("form", "output", "prefix_chars", "middle_chars"), (form, made, *sizes), strict=True):
                out[name].append(value)
        yield out


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = SEED, bound: int = BOUND) -> DataFrame:
    """All columns of ``docs`` with n, form, output, prefix_chars and middle_chars, a row per row.

    Prefix, middle and suffix are cut at two token ends drawn from the hash of
    seed and key. ``form`` is plain (the text as it is; sizes null) for a null
    or empty text, for one that contains a marker, for a null key, and by the
    third draw; else spm or psm. A null text gives an empty output. Columns of
    ``docs`` with a name of the result are replaced. Nothing is shuffled;
    equal rows give equal results.
    """
    bounded_batches(docs.sparkSession)
    made = {"n": "long", "form": "string", "output": "string", "prefix_chars": "long", "middle_chars": "long"}
    kinds = {"n": pa.int64(), "form": pa.string(), "output": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
    fields = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType(fields + [T.StructField(n, {"long": T.LongType(), "string": T.StringType()}[k]) for n, k in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(batch.num_columns - 5), batch.num_columns - 5
            drawn = [batch.column(own + 1 + k) for k in range(4)]
            keyed = drawn[0].is_valid().to_numpy(zero_copy_only=False)
            h = [d.fill_null(0).to_numpy() for d in drawn]
            at = 0
            for part in _arranged(texts, h, keyed, bound):
                rows = len(part["n"])
                kept = [batch.column(i).slice(at, rows) for i in range(own)]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(part[n], kinds[n]) for n in made], [f.name for f in schema.fields])
                at += rows

    source = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col("text").cast("string").alias("_text"), *draws(key, seed))
    return source.toDF(*[f"c{i}" for i in range(len(source.columns))]).mapInArrow(run, schema)  # names may clash, places do not


def restored(output: str = "output", form: str = "form") -> Column:
    """The text before the rearrangement. Markers are found as such, since no piece contains one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


OP11_SQL = rf"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id) AS digest,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
    FROM documents
),
drawn AS (
    SELECT *, len(tokens) AS n,
           CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(tokens) + 1) AS a,
           CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(tokens) + 1) AS b,
           CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS d
    FROM cut
),
formed AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                        OR coalesce(c >= {PLAIN_PERCENT}, TRUE) THEN 'plain'
                   WHEN d < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(tokens[1:least(a, b)], '') AS p,
           array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(tokens[greatest(a, b) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM formed
"""
