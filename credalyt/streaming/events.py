"""Structured Streaming over events: windows with watermarks, sessions and resumable batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_time(events: DataFrame, time_col: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 day", late: str | None = None, time_col: str = "ts") -> DataFrame:
    """(start, event_type, n, value): counts and sums for each window."""
    return sliding(events, every, every, late, time_col)


def sliding(events: DataFrame, length: str = "2 days", step: str = "1 day", late: str | None = None, time_col: str = "ts") -> DataFrame:
    """Overlapping windows; the same plan for tables and streams."""
    rows = with_time(events, time_col)
    rows = rows.withWatermark(time_col, late) if late else rows
    return rows.groupBy(F.window(time_col, length, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "12 hours", late: str | None = None, time_col: str = "ts") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    rows = with_time(events, time_col)
    rows = rows.withWatermark(time_col, late) if late else rows
    return rows.groupBy("user_id", F.session_window(time_col, gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def read_stream(spark: SparkSession, folder: str, schema, files_each: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, then stop; a later run goes on behind it."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
