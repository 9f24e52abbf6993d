"""Windowed aggregates of an event stream; each works on a batch frame as well."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_totals(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their values by window and type. State is dropped once the watermark has passed a window."""
    return _stamped(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    return _stamped(events, late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def session_totals(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return _stamped(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _stamped(events: DataFrame, late: str) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now; the result is a table in the driver's memory, for small results."""
    name = f"stream_{uuid.uuid4().hex}"
    running = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return stream.sparkSession.table(name)
