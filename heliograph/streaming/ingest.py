"""Structured Streaming over the catalogue: an extra that the batch operators do not depend on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def watch(spark: SparkSession, folder: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Hands every new Parquet file's rows to ``handle`` once, in micro-batches; all that is there, or every so many seconds."""
    rows = spark.readStream.schema(schema).parquet(folder)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(handle).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events in windows of event time; works on streams (with a watermark) and on tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
