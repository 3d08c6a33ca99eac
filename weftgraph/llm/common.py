"""Helpers shared by the operators: the shared folder, materialised tables, bounded Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Bytes of one Arrow batch handed to a Python worker, so that many long texts never meet in one batch.
BATCH_BYTES = 2 << 20

#: The most that ``sized`` lets a join broadcast.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or (only where it is unset, as in tests) a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The paths that each open ``freed`` deletes at its end, the innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of executors.

    Within ``freed`` the table lasts until its end, with ``keep`` until that of the next one around it.
    """
    path = scratch(df.sparkSession, name)
    for paths in _MADE.get()[::-1][keep : keep + 1]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs, which else lie there until the driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def freed(spark: SparkSession, also: list[str] | None = None):
    """Deletes the tables that are materialised within, and ``also``, at its end or on an error; a result is stored with ``keep``."""
    paths = list(also or [])
    before = _MADE.set((*_MADE.get(), paths))
    try:
        yield
    finally:
        _MADE.reset(before)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        release_shuffles(spark)


def sized(df: DataFrame, row_bytes: int = 8) -> DataFrame:
    """A materialised table of fixed-size rows, marked for broadcast if it is measured to fit ``BROADCAST_BYTES``.

    Beyond that the join stays with Spark, which shuffles both sides.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES``; rows a batch stay as the session has them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    try:
        small = now is not None and 0 < int(now) <= BATCH_BYTES
    except ValueError:
        small = True  # set by hand, in units
    if not small:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(rows):
    """Runs a Python task's generator and then returns its freed memory, as workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
