"""Event-time windows over a stream of events.

An extension: batch data are enough for everything else here.  The functions take
a batch or streaming DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_totals(events: DataFrame, *, time: str = "ts", by: str = "event_type", value: str = "value", length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, by, n, total) of each window; rows later than ``late`` are dropped from a stream."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late)
    window = F.window("__t", length, slide) if slide else F.window("__t", length)
    out = rows.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def sessions(events: DataFrame, *, time: str = "ts", by: str = "user_id", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(by, start, end, n) of the runs of each user's events without a longer pause."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")
