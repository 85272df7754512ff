"""Shared scratch space and shipping of worker code.

Lineage is cut by writing Parquet below the folder that the session names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a temporary
folder takes its place. Scratch tables are dropped when the application ends.
"""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Seconds between two calls of tidy() that do something.
EVERY = 8
_tidied = [0.0]


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # the session may have ended; the folder is scratch space
            pass


atexit.register(_drop_all)


def clear() -> None:
    """Drop all scratch tables now: for sessions that run many queries, once no earlier result is read any more."""
    _drop_all()
    _written.clear()


def release(df: DataFrame) -> None:
    """Drop the table that materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        drop(df.sparkSession, path)
        _written.remove((df.sparkSession, path))


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once and return a reader of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def tidy(spark: SparkSession) -> None:
    """Drop what ended queries hold on the driver, for loops that run many: plans that Python refers to, and the broadcasts of these."""
    if time.monotonic() - _tidied[0] >= EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has the shuffle files of each query inside dropped as it ends; none of these queries is run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lower the Arrow batch size where it still has Spark's default: rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
