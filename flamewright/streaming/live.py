"""Beyond batch: the timeline of a growing trace as a stream of event rows.

Events arrive as JSON lines (or any stream in the event schema); ``stamp`` turns trace microseconds into event time so that
watermarks close buckets.  State is one row an open bucket and trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EVENTS


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows from a folder that receives JSON-lines files."""
    return spark.readStream.schema(EVENTS).json(folder)


def stamp(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.timestamp_micros(F.col("ts").cast("bigint")))


def live_timeline(events: DataFrame, bucket: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """(trace_id, start, events, runtask_us, dropped) of each tumbling bucket; rows later than ``late`` are left out."""
    rows = stamp(events).withWatermark("at", late).groupBy("trace_id", F.window("at", bucket).alias("w"))
    run = F.when(F.col("name") == "RunTask", F.coalesce("dur", F.lit(0.0))).otherwise(0.0)
    out = rows.agg(F.count("*").alias("events"), F.sum(run).alias("runtask_us"), F.count_if(F.col("name") == "DroppedFrame").alias("dropped"))
    return out.select("trace_id", F.col("w.start").alias("start"), "events", "runtask_us", "dropped")
