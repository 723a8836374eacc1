"""Quality scores from document statistics.

Statistics of the whole text (lengths, character classes, repetition, lines)
are computed once and written. A Gaussian kernel over them is approximated by
random Fourier features; ridge regression on these needs only sums, which
every partition makes on its own and which are then added up row by row.
Isotonic regression turns the raw score into a share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bounded_batches, crc_remainder, map_batches, table, written

#: Labelled rows to learn from, expected number (chosen by a hash of the statistics).
TRAIN_ROWS = 200_000
#: Tasks that sum the normal equations.
TRAIN_TASKS = 16
FEATURES = 256
RIDGE = 0.003
#: Width of the kernel in standard deviations per statistic.
WIDTH = 1.5
#: Bins of the raw score for the isotonic fit.
BINS = 1000
THRESHOLD = 0.3
SEED = 20240229

_CLASSES = np.full(256, 6)
_CLASSES[list(range(97, 123))] = 0
_CLASSES[list(range(65, 91))] = 1
_CLASSES[list(range(48, 58))] = 2
_CLASSES[[32, 9, 11, 12, 13]] = 3
_CLASSES[10] = 4
_CLASSES[[ord(c) for c in ".,;:'\"?-"]] = 5
_CLASSES[128:] = 7
_CLASSES[[ord(c) for c in "|"]] = 8
_CLASSES[[ord(c) for c in "!"]] = 9
_N_CLASSES = 10
N_STATISTICS = 20


def _top_share(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and occurrences of the most frequent one, per row."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    new = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(rows)))
    most = np.zeros(n)
    np.maximum.at(most, rows[at], times)
    return np.bincount(rows[at], minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, rows by statistics; zeros for null and empty ones."""
    out = np.zeros((len(column), N_STATISTICS))
    data, at = tb.string_parts(column)
    classes = np.zeros((len(column), _N_CLASSES))
    for first, last in tb.runs(at):
        size = np.diff(at[first : last + 1])
        for lo in range(int(at[first]), int(at[last]), tb.BLOCK):  # a long text block by block
            hi = min(int(at[last]), lo + tb.BLOCK)
            row = np.repeat(np.arange(last - first), size)[lo - at[first] : hi - at[first]] if last > first + 1 else 0
            found = np.bincount(row * _N_CLASSES + _CLASSES[data[lo:hi]], minlength=(last - first) * _N_CLASSES)
            classes[first:last] += found.reshape(-1, _N_CLASSES)
    for first, counts, words in tb.word_hashes(column):
        n = len(counts)
        row = np.repeat(np.arange(n), counts)
        part = out[first : first + n]
        many = np.maximum(counts, 1)
        distinct, most = _top_share(row, words, n)
        part[:, 0] = np.log1p(counts)
        part[:, 1] = distinct / many
        part[:, 2] = most / many
        same = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
        repeat = same & (words[1:] == words[:-1])
        part[:, 3] = np.bincount(row[1:][repeat], minlength=n) / many
        pairs = words[:-1][same] * tb.STEPS[60] + words[1:][same] * tb.STEPS[61]
        two, most = _top_share(row[1:][same], pairs, n)
        part[:, 4] = two / np.maximum(counts - 1, 1)
        part[:, 5] = most / np.maximum(counts - 1, 1)
    size = np.maximum(classes.sum(1), 1)
    words = np.expm1(out[:, 0])
    lines = classes[:, 4] + 1
    out[:, 6] = np.log1p(classes.sum(1))
    out[:, 7] = (size - classes[:, 3] - classes[:, 4]) / np.maximum(words, 1)
    out[:, 8 : 8 + _N_CLASSES] = classes / size[:, None]
    out[:, 18] = classes[:, 1] / np.maximum(classes[:, 0] + classes[:, 1], 1)
    out[:, 19] = np.log1p(words / lines)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of ``text`` as ``x``, a row per row."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        found = statistics(batch.column(1))
        at = pa.array(np.arange(len(found) + 1) * N_STATISTICS, pa.int32())
        return {"doc_id": batch.column(0), "x": pa.ListArray.from_arrays(at, pa.array(found.ravel()))}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Scaling, random features, ridge weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        draw = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = draw.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), FEATURES))
        self.phases = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.raw, self.calibrated = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.calibrated), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence closest to ``values``, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
            last[2] += n
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def train(rows: DataFrame) -> Model:
    """Fit on rows (x, y), y being 0 or 1. Without rows every score is 0.5."""
    sums = rows.agg(F.count("*"), *[f(F.element_at("x", i + 1)) for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not sums[0]:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    model = Model(np.array(sums[1::2]), np.array(sums[2::2]))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                phi = shared.value.features(_matrix(batch.column(0)))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                total += phi.T @ np.hstack([phi, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(total.tolist())], ["i", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "sums": [np.sum(pdf["sums"].tolist(), axis=0)]})

    parts = rows.select("x", "y").repartition(TRAIN_TASKS).mapInArrow(add, "i int, sums array<double>")
    summed = parts.groupBy("i").applyInPandas(added, "i int, sums array<double>").toPandas().sort_values("i")
    both = np.array(summed["sums"].tolist())
    penalty = RIDGE * sums[0] * np.append(np.full(FEATURES, 1.0), 0.0)
    model.weights = np.linalg.solve(both[:, :-1] + np.diag(penalty + 1e-9), both[:, -1])
    fitted = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batch: pa.RecordBatch) -> dict:
        raw = fitted.value.raw_scores(_matrix(batch.column(0)))
        return {"bin": pa.array(np.clip(np.floor(raw * BINS), -BINS, 2 * BINS).astype(np.int64)), "raw": pa.array(raw), "y": pa.array(batch.column(1).to_numpy(zero_copy_only=False).astype(float))}

    bins = map_batches(rows.select("x", "y"), binned, "bin long, raw double, y double")
    steps = bins.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("raw")
    model.raw = steps["raw"].to_numpy()
    model.calibrated = isotonic(steps["y"].to_numpy(), steps["n"].to_numpy(float))
    return model


def labelled(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """x and y of about ``rows`` labelled documents that are not held out; null labels and ids are not used."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.filter(crc_remainder("doc_id", 5) != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    joined = written(stats.join(known, "doc_id").select("x", "y"), "labelled")
    share = rows / max(1, joined.count())
    return joined.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs`` (doc_id, text), from the text alone.

    Null and empty texts are scored as a text with all statistics 0. Labels
    are (doc_id, quality); repeated ones count repeatedly, rows that repeat a
    doc_id are scored one by one. With one class of labels every score is
    that class, with none 0.5.
    """
    stats = written(with_statistics(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(train(labelled(stats, labels)))

    def run(batch: pa.RecordBatch) -> dict:
        scores = model.value.scores(_matrix(batch.column(1)))
        return {"doc_id": batch.column(0), "score": pa.array(scores), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32))}

    return map_batches(stats, run, "doc_id long, score double, predicted int")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
