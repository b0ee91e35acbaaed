"""Structured Streaming variants of the alert reports.

The reference has no streaming operator; its alert lists are the natural
R-TL9 (days with a single clock punch): clock events arrive as a stream,
a one-day event-time window per person counts the punches, and the
watermark closes a day once events are later than the allowed lateness,
so state stays bounded by the open days.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The events table of ``source_dir`` read as a file stream."""
    return (spark.readStream.schema(EVENTS_SCHEMA)
            .option("pathGlobFilter", "events*.parquet")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))


def punch_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Punches per person and day (event-time window, watermarked)."""
    clicks = events.filter(F.col("event_type") == "click").withColumn("ts_ltz", F.col("ts").cast("timestamp"))
    return (clicks.withWatermark("ts_ltz", lateness)
            .groupBy(F.window("ts_ltz", "1 day").alias("day"), F.col("user_id").alias("person_id"))
            .agg(F.count(F.lit(1)).alias("punches"), F.min("ts").alias("first_in")))


def single_punch_days(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("punches") == 1).select(
        "person_id", F.to_date(F.col("day.start")).alias("work_date"), F.col("first_in").alias("only_punch"))


def start_punch_alerts(spark: SparkSession, source_dir: str, sink_dir: str, name: str = "punch_alerts",
                       output_mode: str = "append", trigger_once: bool = True):
    """Start the streaming alert: counts are kept in the state store and the
    closed days with a single punch are appended to ``sink_dir`` (Parquet).

    The checkpoint goes under the session's ``spark.checkpoint.dir`` (a
    shared folder on a cluster), so a restarted query resumes exactly.
    """
    from tallyspark.session import checkpoint_dir
    ckpt = os.path.join(checkpoint_dir(spark), f"stream-{name}")
    counts = punch_counts(event_stream(spark, source_dir))

    def write_batch(batch: DataFrame, epoch: int) -> None:
        single_punch_days(batch).write.mode("append").parquet(sink_dir)

    writer = counts.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).queryName(name)
    writer = writer.foreachBatch(write_batch)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
