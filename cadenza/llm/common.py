"""Helpers shared by the text operators: shared-folder materialisation, bounded-size checks, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` where the session names one.

    Only a session without that setting (a local test) falls back to a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), "cadenza-checkpoints")
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts lineage, survives lost executors.

    Shuffle files that only ``df`` needed are of no further use; a garbage collection on the driver lets Spark's cleaner
    delete them now, not half an hour later.
    """
    spark, schema, path = df.sparkSession, df.schema, table_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def table_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/cadenza/{label}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cadenza/" in name:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A side of a join is broadcast only if it holds at most this many rows (of at most a few dozen bytes each).
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small; otherwise unchanged, so Spark shuffles the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Keys that may be joined by broadcast for being hot: each has more than one row in so many.
HOT_KEYS = 1000


def join_with_hot_keys(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (one row for each value of ``keys``, which names its number of ``rows``).

    Keys that hold more than one in ``HOT_KEYS`` of all ``total`` rows, which are fewer than ``HOT_KEYS``, are broadcast,
    so their rows stay where they are; the others are shuffled, and none of them fills a task.
    """
    edge = max(10_000, total // HOT_KEYS)
    hot = F.broadcast(unique.where(F.col(count) > edge).drop(count))
    cold = unique.where(F.col(count) <= edge).drop(count)
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """True where crc32 of the decimal doc_id leaves remainder 0 modulo 5; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


Batches = Iterator[pa.RecordBatch]


def portions(batch: pa.RecordBatch, column: int, most: int) -> Batches:
    """Consecutive rows that hold about ``most`` bytes in a column of strings or bytes; one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, giving back the memory that it took once a task is done."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
