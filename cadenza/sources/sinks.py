"""Writers: factor tables, daily tables by entity, wide exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where none is set (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (found or f"file://{tempfile.gettempdir()}/cadenza-scratch").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own, written once: cuts lineage, and survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_factors(long: DataFrame, path: str) -> None:
    """(e, m, factor, value) as zstd parquet, one folder for each factor, values as floats."""
    narrow = long.select("e", "m", F.col("value").cast("float").alias("value"), "factor")
    narrow.write.mode("overwrite").option("compression", "zstd").partitionBy("factor").parquet(path)


def write_daily(rows: DataFrame, path: str, buckets: int = 64) -> int:
    """Daily rows in hash buckets of the entity, sorted by entity and day; returns the number of rows, which is checked."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("e"), F.lit(buckets)))
    # One shuffle by bucket and a salt of the entity, so that a bucket may have several files and tasks stay small.
    dealt = placed.repartition("bucket", F.pmod(F.hash("e"), F.lit(8))).sortWithinPartitions("bucket", "e", "d")
    # Rows are counted as they are written, not by evaluating them again.
    seen = Observation()
    dealt.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
    before, after = seen.get["n"], rows.sparkSession.read.parquet(path).count()
    if before != after:
        raise RuntimeError(f"{before} rows became {after}")
    return after


def read_daily(spark, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of all buckets, or of some, which are the only ones that are scanned."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows


def export_wide(long: DataFrame, factor: str) -> DataFrame:
    """One row for each month and one column for each entity: for small exports only, since columns are collected."""
    return long.where(F.col("factor") == factor).groupBy("m").pivot("e").agg(F.max(F.col("value").cast("float"))).orderBy("m")
