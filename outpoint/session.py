"""Session helpers: where intermediate tables live and how they are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Of tables that are written. Most of their bytes are hashes as hex, which only an entropy coder makes smaller.
COMPRESSION = "zstd"

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir`` and clears it when the
    application is over. Only a local session without that setting gets a
    temporary folder, which goes when the process ends.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not named:
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="outpoint-")
            atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
        named = f"file://{_local_dirs[app]}"
    return f"{qualified(spark, named).rstrip('/')}/outpoint/{app}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark resolves it against."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(place).toString()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def compact_writer(df: DataFrame) -> DataFrameWriter:
    return df.write.option("compression", COMPRESSION)


#: Per thread the folders that ``materialize`` has written within each ``passing`` block that is open.
_passing = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized in this block go when it ends, also by an error.

    For steps of a job whose results are written elsewhere, or by
    ``materialize`` with ``keep``. Writes in the block have ``SETTINGS``.
    """
    scopes = _passing.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        with _settings(spark):
            yield
    finally:
        for path in scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


#: How many times as much memory rows of keys take as their file, which is what Spark judges a broadcast by.
IN_MEMORY = 10

#: Of the writes in a ``passing`` block: shuffle files go when a write is done and not when the driver happens to collect garbage,
#: and a table is broadcast if its rows are few, not if its file is small.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.sources.fileCompressionFactor": str(float(IN_MEMORY)),
}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``SETTINGS`` for a while."""
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """Write a frame as Parquet and read it back, which cuts its lineage.

    Unlike a cached frame the result survives the loss of any executor. It
    goes with the ``passing`` block that is open, unless it is to ``keep``.
    """
    path = new_path(df.sparkSession, label)
    scopes = getattr(_passing, "scopes", None)
    if scopes and not keep:
        scopes[-1].append(path)
    compact_writer(df).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
