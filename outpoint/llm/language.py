"""Language identification with one bit-sliced Bloom filter for all languages.

A filter cell is a bitmask with a bit per language. The cells of an n-gram,
and-ed, give all languages that contain it. A text counts for each language
how many of its n-grams the language contains, takes off what the filter's
fill makes by chance, and the language with the largest share decides.

A language's n-grams are those of a sample of its texts, and frequent there
compared with the language where they are most frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import bounded_batches, crc_remainder, map_batches, table, texts_of, written

#: Texts per language to learn from, expected number (chosen by a hash of the text).
SAMPLE = 2000
#: N-grams per language in the filter.
GRAMS = 1 << 16
#: Cells of the filter (a bitmask for up to 64 languages takes 8 bytes) and cells of an n-gram.
CELLS = 1 << 20
HASHES = 3
#: An n-gram belongs to a language where its share is at least this part of its largest share.
RATIO = 0.3
SIZES = (3, 4)
UNKNOWN = "und"
#: Texts of which a smaller share of n-grams is known are in no learned language.
LEAST_SCORE = 0.2

_U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _blocks(texts: list[str], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > size:
            yield first, i
            first, held = i, 0
        held += len(text)
    if len(texts) > first:
        yield first, len(texts)


def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row, hash) of all n-grams of lower-cased letters, other characters being one space."""
    for first, last in _blocks(texts):
        joined = "\n" + "\n".join(t.lower() for t in texts[first:last]) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t.lower()) + 1 for t in texts[first:last]])
        row = np.repeat(np.arange(last - first), lengths)
        row = np.append(0, row)
        letter = _letters()[code]
        keep = letter.copy()  # and the first other character after a letter
        keep[1:] |= letter[:-1]
        keep[0] = True
        code = np.where(letter, code, 32)[keep].astype(np.uint64) + _U(1)
        row = row[keep]
        solid = letter[keep]
        for n in SIZES:
            count = len(code) - n + 1
            if count <= 0:
                continue
            value = np.full(count, n, np.uint64)
            has = np.zeros(count, bool)
            for k in range(n):
                value += code[k : k + count] * tb.STEPS[16 + k]
                has |= solid[k : k + count]
            # A gram belongs to the text of its second character; its first may be the space before it.
            owner = row[1 : 1 + count]
            has &= owner == row[n - 1 : n - 1 + count]
            yield first, owner[has], tb.mixed(value[has])


def learn(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, the filter, and each language's rate of chance hits.

    Rows without label are not used. The filter is bounded by ``GRAMS`` per language.
    """
    bounded_batches(docs.sparkSession)
    known = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((1, 1), np.uint64), np.zeros(0)
    share = F.create_map(*[F.lit(x) for n in names for x in (n, sample / counts[n])])[F.col(label)]
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)

    def count(batch: pa.RecordBatch) -> dict:
        texts, langs = texts_of(batch), batch.column(1).to_pylist()
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang in set(langs):
            mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            found = [h for _, _, h in grams(mine)]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                out["lang"] += [lang] * len(values)
                out["gram"] += values.view(np.int64).tolist()
                out["n"] += n.tolist()
        return {"lang": pa.array(out["lang"], pa.string()), "gram": pa.array(out["gram"], pa.int64()), "n": pa.array(out["n"], pa.int64())}

    sampled = known.filter(drawn).select("text", F.col(label).alias("lang"))
    counted = map_batches(sampled, count, "lang string, gram long, n long")
    summed = written(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = summed.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = summed.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = F.max("share").over(Window.partitionBy("gram"))
    own = shares.withColumn("best", best).filter((F.col("n") >= 2) & (F.col("share") >= RATIO * F.col("best")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = own.withColumn("place", place).filter(F.col("place") <= GRAMS).select("lang", "gram").toPandas()
    return names, *build_filter(names, {n: g["gram"].to_numpy(np.int64) for n, g in rows.groupby("lang")})


def _cells(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((hashes * tb.STEPS[24 + k]) >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def build_filter(names: list[str], by_language: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bitmasks (cells by words of 64 languages) and each language's chance of a hit."""
    masks = np.zeros((CELLS, (len(names) + 63) // 64), np.uint64)
    chance = np.zeros(len(names))
    for i, name in enumerate(names):
        bit = _U(1) << _U(i % 64)
        for cell in _cells(by_language.get(name, np.zeros(0, np.int64)).view(np.uint64)):
            masks[cell, i // 64] |= bit
        chance[i] = float((masks[:, i // 64] & bit != 0).mean()) ** HASHES
    return masks, chance


def score_texts(texts: list[str], names: list[str], masks: np.ndarray, chance: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    hits = np.zeros((len(texts), len(names)))
    total = np.zeros(len(texts))
    for first, row, hashes in grams(texts) if names else ():
        rows = int(row[-1]) + 1 if len(row) else 0
        total[first : first + rows] += np.bincount(row, minlength=rows)
        cells = list(_cells(hashes))
        for word in range(masks.shape[1]):
            column = masks[:, word]
            sets = column[cells[0]]
            for cell in cells[1:]:
                sets &= column[cell]
            for i in range(word * 64, min(len(names), word * 64 + 64)):
                has = ((sets >> _U(i % 64)) & _U(1)).astype(float)
                hits[first : first + rows, i] += np.bincount(row, weights=has, minlength=rows)
    seen = np.maximum(total, 1)[:, None]
    corrected = np.clip((hits / seen - chance) / np.maximum(1 - chance, 1e-9), 0, 1) if names else hits
    lang, score = [], []
    for i, text in enumerate(texts):
        if not names or not total[i] or not any(c.isalpha() for c in text):
            lang.append(UNKNOWN)
            score.append(0.0)
        else:
            best = int(np.argmax(corrected[i]))
            lang.append(names[best])
            score.append(float(corrected[i, best]))
    return lang, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, from ``text`` alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Ties go to the smaller language. The score is the share of the text's
    n-grams that the language contains, corrected for chance.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    at = [docs.columns.index(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score = score_texts(texts_of(batch), *shared.value)
                columns = [*(batch.column(i) for i in at), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "lang_pred", "score"])

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def train_on(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model from the documents that are not held out."""
    return learn(docs.filter(crc_remainder("doc_id", 3) != 1))


def known_language(docs: DataFrame) -> DataFrame:
    """Documents in a learned language, a missing ``lang`` as predicted; the others go."""
    found = identify(docs, train_on(docs))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), train_on(docs))
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
