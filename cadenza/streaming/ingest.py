"""Incremental monthly panels from a stream of daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_days(spark: SparkSession, path: str, schema: str = "e BIGINT, ts TIMESTAMP, value DOUBLE", per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily_statistics(rows: DataFrame, late: str = "3 days") -> DataFrame:
    """(e, day, n, total, top): one row for each entity and day, final once the watermark has passed the day.

    State is one row for each entity and open day, whatever the number of rows.
    """
    day = F.window("ts", "1 day")
    grouped = rows.withWatermark("ts", late).groupBy("e", day.alias("w"))
    return grouped.agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")).select("e", F.col("w.start").alias("day"), "n", "total", "top")


def append_to(stats: DataFrame, path: str, checkpoint: str):
    """Start a query that appends finished days to a parquet folder and ends when the input is used up."""
    return stats.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
