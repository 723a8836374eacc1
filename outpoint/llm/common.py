"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of an Arrow batch with whole texts; keeps a batch small when texts are long.
TEXT_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from a table in the shared folder: lineage is cut, losing an executor costs nothing."""
    return materialize(df, f"llm-{label}")


def bounded_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Send at most ``rows`` rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of a number as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_batches(df: DataFrame, per_batch, schema: str, at_end: Callable[[], None] | None = None) -> DataFrame:
    """``per_batch`` (a record batch to a dict of columns) over all batches, Arrow both ways.

    A task gives its memory back at its end, as workers outlive tasks;
    ``at_end`` drops what the task itself has kept.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    columns = per_batch(batch)
                    yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})
        finally:
            if at_end:
                at_end()
            gc.collect()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
