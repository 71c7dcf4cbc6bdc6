"""File-source streams and the shared way of running them to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from evalframe.functions.fixed_values import POLL_SECONDS
from evalframe.functions.times import iso_utc

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def event_stream(
    spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Stream of event files; times become zoned, as watermarks need."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def observation_stream(events: DataFrame) -> DataFrame:
    return events.select(
        F.pmod("user_id", F.lit(20)).cast("bigint").alias("system"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("id"),
        (F.col("event_type") != "error").alias("ok"),
        "value",
    )


def harvest_stream(events: DataFrame) -> DataFrame:
    """Each event as a harvest that has been put together, good or failed."""
    return events.select(
        F.pmod("user_id", F.lit(20)).cast("bigint").alias("system"), F.col("ts").alias("at"), F.col("event_id").alias("id"),
        (~F.col("event_type").isin("error", "signup")).alias("ok"),
        F.get_json_object("props", "$.k").cast("bigint").alias("commits_30d"),
        (F.col("event_id") + 2).alias("commits_total"),
        F.floor(F.col("value") * 1_000).cast("bigint").alias("repo_stars"),
        F.col("event_type").alias("primary_language"), iso_utc(F.col("ts")).alias("last_commit_at"),
    )


def workload_stream(events: DataFrame) -> DataFrame:
    return events.select(
        F.pmod("user_id", F.lit(20)).cast("bigint").alias("system"),
        F.col("user_id").alias("actor"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("at"),
    )


def run_at_interval(writer: DataStreamWriter, checkpoint: str, seconds: int = POLL_SECONDS) -> StreamingQuery:
    """Keep processing what arrives, one micro-batch per poll interval."""
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process all that is there now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
