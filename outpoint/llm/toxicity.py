"""Toxic passages as maximum-scoring segments of token log-odds.

Every word has the log-odds of standing in toxic texts, under a Dirichlet
prior that pulls words with little evidence to zero. A linear-time scan finds
all maximal segments of a text: stretches whose summed log-odds cannot grow by
any change of their ends. What the best segment of a clean text scores follows
an extreme-value law; its two parameters are fitted on clean texts that the
words were not learned from. They turn the score of a segment into the number
of segments as good that a clean text of that length has by chance, and all
segments of a text together into a probability.

Words are counted in two tables of fixed size under two hashes, and the
smaller log-odds counts, so a word passes for toxic only if it collides twice.
Near copies share their counts: texts with the same least shingle, under one of
several orders, weigh as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bounded_batches, crc_remainder, map_batches, table, written
from .lists import id_filter, in_filter

#: Cells of each of the two tables of words, as a power of two (8 MB of log-odds together).
BITS = 20
#: Texts that the prior is worth, for every word.
PRIOR = 5.0
#: What each token costs, so that a clean text drifts down.
DRIFT = 0.1
#: Standard deviations by which log-odds are drawn to zero.
DOUBT = 2.0
#: Orders of shingles whose least ones are compared to find copies.
ORDERS = 4
#: One of so many groups of copies serves to fit the extreme-value law.
FOLDS = 5
#: A passage is toxic if a clean text has fewer of its kind by chance.
ALPHA = 0.05
THRESHOLD = 0.7
#: Cells of the histogram of log-odds, and its reach on either side.
BINS, REACH = 3200, 16.0
#: Part of the clean texts whose best segments show how the tail falls off, and the largest score told apart there.
TAIL = 0.1
PEAK = 100.0

_U = np.uint64
_CELLS = 1 << BITS
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words: runs of letters, digits and bytes above 127; they end at ``breaks``, too."""
    word = _WORD[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    begin[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def _long_text(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one long text block by block; blocks end beside a word."""
    at = 0
    while at < len(data):
        end = min(len(data), at + tb.BLOCK)
        while end < len(data) and _WORD[data[end - 1]]:
            stop = np.flatnonzero(~_WORD[data[end : end + tb.BLOCK]])
            end = end + int(stop[0]) + 1 if len(stop) else min(len(data), end + tb.BLOCK)
        part = data[at:end]
        begin, stop = _spans(part, np.zeros(0, np.int64))
        yield begin + at, stop + at, tb.span_hashes(part, begin, stop)
        at = end


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words per row, begins, ends, codes of 40 bits) for runs of rows; bounds are bytes of the own text."""
    data, at = tb.string_parts(column)
    for first, last in tb.runs(at):
        part = data[at[first] : at[last]]
        if len(part) > tb.BLOCK and last == first + 1:
            begin, end, hashes = (np.concatenate(x) for x in zip(*_long_text(part), strict=True))
            counts = np.array([len(begin)])
        else:
            edges = at[first : last + 1] - at[first]
            begin, end = _spans(part, edges)
            counts = np.diff(np.searchsorted(begin, edges))
            hashes = tb.span_hashes(part, begin, end) if len(begin) else np.zeros(0, np.uint64)
            start = np.repeat(edges[:-1], counts)
            begin, end = begin - start, end - start
        yield first, counts, begin, end, hashes >> _U(64 - 2 * BITS)


def _packed(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all maximal-scoring segments of a sequence, in order.

    Segments are disjoint, their scores positive; every positive stretch lies
    in one. Linear: a candidate remembers the nearest earlier one with less
    before it, so each candidate is stepped over once.
    """
    up = scores > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    if not len(edges):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    before, after, first, last, lower = [], [], [], [], []
    for b, e, x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), total[edges[::2]].tolist(), total[edges[1::2]].tolist(), strict=True):
        while True:
            j = len(before) - 1
            while j >= 0 and before[j] >= x:
                j = lower[j]
            if j < 0 or after[j] >= y:
                break
            b, x = first[j], before[j]  # joined with what lies between
            del before[j:], after[j:], first[j:], last[j:], lower[j:]
        for stack, value in ((before, x), (after, y), (first, b), (last, e), (lower, j)):
            stack.append(value)
    return [(b, e, y - x) for b, e, x, y in zip(first, last, before, after, strict=True)]


@dataclass
class Model:
    """Log-odds of words in two tables, the price of a token, the extreme-value law and the share of toxic texts."""

    odds: np.ndarray = field(default_factory=lambda: np.zeros((2, _CELLS), np.float32))
    drift: float = DRIFT
    rate: float = 1.0
    scale: float = 1.0
    prior: float = 0.5

    def raw(self, codes: np.ndarray) -> np.ndarray:
        low = self.odds[0][(codes & _U(_CELLS - 1)).astype(np.int64)]
        high = self.odds[1][(codes >> _U(BITS)).astype(np.int64)]
        return np.minimum(low, high).astype(float)

    def values(self, codes: np.ndarray, starts: np.ndarray = np.zeros(1, np.int64)) -> np.ndarray:
        """What each word of texts that begin at ``starts`` adds; one that repeats the word before it says nothing new."""
        raw = self.raw(codes)
        again = np.zeros(len(codes), bool)
        again[1:] = codes[1:] == codes[:-1]
        again[starts[starts < len(codes)]] = False
        raw[again] = np.minimum(raw[again], 0)
        return raw - self.drift

    def expected(self, score: float, length: int) -> float:
        """Segments of at least this score that a clean text of ``length`` words has by chance."""
        return self.scale * length * math.exp(-min(self.rate * score, 700.0))

    def probability(self, scores: list[float], length: int) -> float:
        """How likely a clean text of that length has segments as good, the best one, two, three and so on together."""
        if not scores or not length:
            return 1.0
        level = math.log(self.scale * length)
        least = math.log(-math.expm1(-self.expected(max(scores), length)) or 1e-300)
        total, r = 0.0, 0
        for s in sorted(scores, reverse=True):
            gain = self.rate * s - level
            if gain <= 1:
                break
            total, r = total + gain, r + 1
            if r > 1:  # sum statistics, at a price of one bit per segment
                p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
                least = min(least, p)
        return math.exp(max(min(least, 0.0), -690.0))

    def score(self, scores: list[float], length: int) -> float:
        """Probability of being toxic: the share of toxic texts, raised by at most what the evidence can bear."""
        p = self.probability(scores, length)
        against = -math.e * p * math.log(p) if p < 1 / math.e else 1.0
        return self.prior / (self.prior + (1 - self.prior) * against)


def training_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(words, y, fit, weight) of each labelled text.

    Words are distinct, but whole sequences where ``fit`` says that they serve
    to fit the extreme-value law. Null ids and labels other than 0 and 1 are
    not used; a text with both labels is toxic. Words are moved once, to their
    labels and weights.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = written(known, "toxic-labels")
    asked = spark.sparkContext.broadcast(id_filter(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(in_filter(asked.value, ids))))
            for first, counts, _, _, codes in tokens(batch.column(1)):
                least = np.full((ORDERS, len(counts)), np.iinfo(np.uint64).max)
                rows, shingles = tb.shingles(counts, codes)
                for k in range(ORDERS):
                    np.minimum.at(least[k], rows, tb.mixed(shingles * tb.STEPS[40 + k]))
                fit = tb.mixed(least[0]) % _U(FOLDS) == 0
                at = np.concatenate([[0], np.cumsum(counts)])
                parts = (codes[lo:hi] for lo, hi in zip(at, at[1:], strict=False))
                packed = [_packed(p if f else np.unique(p)) for p, f in zip(parts, fit, strict=True)]
                orders = pa.array(least.T.view(np.int64).tolist(), pa.list_(pa.int64()))
                columns = [batch.column(0).slice(first, len(counts)), orders, pa.array(fit), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "least", "fit", "words"])

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(texts.mapInArrow(run, "doc_id long, least array<long>, fit boolean, words binary"), "toxic-words")
    weighed = weights(found.select("doc_id", "least").join(known, "doc_id", "left_semi"))
    beside = written(weighed.join(known, "doc_id"), "toxic-weights")
    return written(found.select("doc_id", "fit", "words").join(beside, "doc_id").drop("doc_id"), "toxic-training")


def weights(rows: DataFrame) -> DataFrame:
    """(doc_id, weight): one over the most texts that share a least shingle of the text in one order."""
    each = rows.select("doc_id", F.posexplode("least").alias("order", "shingle"))
    copies = each.groupBy("order", "shingle").agg(F.count(F.lit(1)).alias("copies"))
    most = each.join(copies, ["order", "shingle"]).groupBy("doc_id").agg(F.max("copies").alias("most"))
    return most.select("doc_id", (1 / F.col("most")).alias("weight"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(cell, toxic, clean): in how many texts a word of the cell stands; a row (words, y, weight) is a text.

    Cells below ``2 ** BITS`` are those of the first hash, the others of the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 * _CELLS))
        for batch in batches:
            for words, y, weight in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes = _unpacked(words)
                for cells in (codes & _U(_CELLS - 1), (codes >> _U(BITS)) + _U(_CELLS)):
                    sums[y][np.unique(cells).astype(np.int64)] += weight
        cells = np.flatnonzero(sums.any(axis=0))
        for at in range(0, len(cells), 1 << 16):
            part = cells[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[1][part]), pa.array(sums[0][part])], ["cell", "toxic", "clean"])

    parts = rows.select("words", "y", "weight").mapInArrow(run, "cell int, toxic double, clean double")
    return parts.groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame) -> np.ndarray:
    """Log-odds of every cell, less their doubt, as a table of fixed size. Zero where one class has no words."""
    odds = np.zeros((2, _CELLS), np.float32)
    toxic, clean = counts.filter(F.col("cell") < _CELLS).agg(F.sum("toxic"), F.sum("clean")).first()
    if toxic and clean:
        share = toxic / (toxic + clean)
        up, down = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * (1 - share)
        odds_of, doubt = F.log(up / toxic) - F.log(down / clean), DOUBT * F.sqrt(1 / up + 1 / down)
        sure = F.signum(odds_of) * F.greatest(F.abs(odds_of) - doubt, F.lit(0.0))
        found = counts.select("cell", sure.cast("float").alias("odds")).filter("odds <> 0").toArrow()
        odds.ravel()[found["cell"].to_numpy()] = found["odds"].to_numpy()
    return odds


def decay(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive rate at which the mean of exp(rate * value) is one; values fall on average and some are positive."""
    lo, hi = 0.0, 1.0
    while hi < 1e3 and np.exp(np.minimum(hi * values, 700)) @ shares < 1:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if np.exp(np.minimum(middle * values, 700)) @ shares < 1 else (lo, middle)
    return hi


def fit_law(model: Model, clean: DataFrame) -> None:
    """Set drift, rate and scale of ``model`` from clean texts (words, weight) that it was not learned from."""
    if not (model.odds > 0).any():
        return
    spark = clean.sparkSession
    shared = spark.sparkContext.broadcast(model.odds)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(shared.value, drift=0.0)
        sums = np.zeros(BINS)
        for batch in batches:
            for words, weight in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                place = np.clip((held.values(_unpacked(words)) + REACH) * (BINS / 2 / REACH), 0, BINS - 1)
                sums += weight * np.bincount(place.astype(np.int64), minlength=BINS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bin", "n"])

    found = clean.select("words", "weight").mapInArrow(histogram, "bin int, n double").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    # One word of the highest log-odds is taken as seen, or a law without chance hits would forbid them.
    values = np.append((found["bin"].to_numpy() + 0.5) * (2 * REACH / BINS) - REACH, float(model.odds.max()))
    shares = np.append(found["n"].to_numpy(), 1.0)
    shares /= shares.sum()
    model.drift = DRIFT + max(0.0, float(values @ shares))
    model.rate = decay(values - model.drift, shares)
    fixed = spark.sparkContext.broadcast(model)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, sizes, weights = [], [], []
        for batch in batches:
            for words, weight in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                codes = _unpacked(words)
                if len(codes):
                    best.append(max((s for _, _, s in maximal_segments(fixed.value.values(codes))), default=0.0))
                    sizes.append(float(len(codes)))
                    weights.append(weight)
        place = np.minimum((np.array(best) * (BINS / PEAK)).astype(np.int64), BINS - 1)
        texts = np.bincount(place, weights, minlength=BINS)
        words = np.bincount(place, np.array(weights) * sizes, minlength=BINS)
        at = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(texts[at]), pa.array(words[at])], ["bin", "texts", "words"])

    found = clean.select("words", "weight").mapInArrow(tails, "bin int, texts double, words double")
    found = found.groupBy("bin").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words")).orderBy("bin").toArrow()
    if found.num_rows:
        best, texts, words = (found.column(i).to_numpy() for i in range(3))
        best = best * (PEAK / BINS)
        # Words of a text are not independent; where the best segments of clean texts fall off more slowly, that counts.
        from_top = np.cumsum(texts[::-1])[::-1]
        tail = from_top <= TAIL * texts.sum()
        tail[-1] = True
        excess = (texts[tail] * (best[tail] - best[tail].min())).sum() + model.odds.max()
        model.rate = min(model.rate, (texts[tail].sum() + 1) / excess)
        model.scale = texts.sum() / (words * np.exp(-np.minimum(model.rate * best, 700))).sum()  # likeliest for this rate


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model from all labelled texts. Without labels every score is 0.5, with one class about that class."""
    rows = training_texts(docs, labels, label)
    toxic, every = rows.agg(F.sum(F.col("y") * F.col("weight")), F.sum("weight")).first()
    model = Model(prior=((toxic or 0.0) + 0.5) / ((every or 0.0) + 1.0))
    model.odds = log_odds(written(word_counts(rows.filter("NOT fit")), "word-counts"))
    fit_law(model, rows.filter("fit AND y = 0"))
    return model


PASSAGES = "array<struct<begin:int,end:int,score:double,expected:double>>"
_PASSAGE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def judged(column: pa.Array, model: Model) -> tuple[list[float], list[list[dict]]]:
    """Score and toxic passages of each text; passages in code points."""
    scores, passages = [], []
    data, at = tb.string_parts(column)
    for first, counts, begin, end, codes in tokens(column):
        bounds = np.concatenate([[0], np.cumsum(counts)])
        values = model.values(codes, bounds[:-1])
        for i, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            found = maximal_segments(values[lo:hi])
            scores.append(model.score([s for _, _, s in found], hi - lo))
            toxic = [(b, e, s, x) for b, e, s in found if (x := model.expected(s, hi - lo)) <= ALPHA]
            mine = []
            if toxic:
                text = data[at[first + i] : at[first + i + 1]]
                place = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                for b, e, s, x in toxic:
                    mine.append({"begin": int(place[begin[lo + b]]), "end": int(place[end[lo + e - 1]]), "score": s, "expected": x})
            passages.append(mine)
    return scores, passages


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and passages for each row of ``docs`` (doc_id, text), from the text alone.

    ``passages`` are all significant toxic ones, as code points of the whole
    text, with their log-odds and how many as good a clean text of this length
    has by chance. A null, empty or wordless text has none; its score is the
    share of toxic texts. Rows that repeat a doc_id are scored one by one,
    other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        scores, passages = judged(batch.column(1), shared.value)
        predicted = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
        return {"doc_id": batch.column(0), "score": pa.array(scores), "predicted": predicted, "passages": pa.array(passages, _PASSAGE)}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, f"doc_id long, score double, predicted int, passages {PASSAGES}")


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learned = crc_remainder("doc_id", 3) != 1
    model = train(docs.filter(learned), table(spark, folder, "labels").filter(learned))
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
