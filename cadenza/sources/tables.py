"""Readers of parquet tables, with declared columns checked against the footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """A table lacks columns that a plan reads."""


def read_parquet(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Scan of the named columns, cast to the given types; a missing column is an error before anything runs."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaError(f"{path} lacks {', '.join(missing)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", columns)


def read_month_csv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(e, m, value) of a CSV with columns permno, yyyymm and a value."""
    df = spark.read.option("header", True).csv(path)
    month = F.col("yyyymm").try_cast("int")
    return df.select(F.col("permno").try_cast("bigint").alias("e"), (F.floor(month / 100) * 12 + month % 100 - 1).cast("int").alias("m"), F.col(value).try_cast("double").alias("value")).where("e IS NOT NULL AND m IS NOT NULL")


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query of a database, read in ranges of a numeric column if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()
