"""Streaming extension: windowed sums of events with late data, and the finding store fed batch by batch.

The batch analytics have no streaming counterpart to match; these are the same aggregates over a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and exact sums per window and key; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: runs of events with no gap of that length."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def feed_store(findings: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Merge every micro-batch of findings into the store; a repeated batch id has to merge to the same store."""
    writer = findings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


