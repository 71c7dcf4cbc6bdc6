"""Windowed workload counters, as streams and over a whole table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evalframe.functions.times import micros
from evalframe.streaming.state import BUCKET, StateTable, buckets_of, hashed


def tumbling(size: str) -> Column:
    return F.window("at", size)


def sliding(size: str, step: str) -> Column:
    return F.window("at", size, step)


def counters(rows: DataFrame, window: Column, keys: list[str], delay: str | None = None) -> DataFrame:
    """Requests, errors and exact total latency per window and keys.

    ``delay`` sets the watermark of a stream: later rows are dropped and closed windows
    leave the state.
    """
    w = F.col("w")
    return _counted(rows, window, keys, delay, w["start"], w["end"])


def session_counters(rows: DataFrame, gap: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """The same per session: requests of one key less than ``gap`` apart.

    The bounds are aggregates, not the session column: Spark pushes a filter on that
    column below the merging of sessions, which would cut sessions apart.
    """
    end = F.max("at") + F.expr(f"INTERVAL {gap}")
    return _counted(rows, F.session_window("at", gap), keys, delay, F.col("_start"), F.col("_end"),
                    F.min("at").alias("_start"), end.alias("_end"))


def _counted(
    rows: DataFrame, window: Column, keys: list[str], delay: str | None, start: Column, end: Column, *bounds: Column
) -> DataFrame:
    timed = rows.withWatermark("at", delay) if delay else rows
    grouped = timed.groupBy(window.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("kind") == "error").alias("errors"),
        F.sum(F.col("latency_ms").cast("decimal(18,4)")).alias("_latency"),
        *bounds,
    )
    return grouped.select(
        start.cast("timestamp_ntz").alias("window_start"), end.cast("timestamp_ntz").alias("window_end"),
        *keys, "requests", "errors", F.col("_latency").cast("double").alias("latency_ms"),
    )


_VALUES = ("requests", "errors", "latency_ms")


def persist_updates(counted: DataFrame, out: str) -> DataStreamWriter:
    """Keep the newest values of every window; a batch rewrites only the days it touches."""
    day = F.date_format("window_start", "yyyy-MM-dd").alias(BUCKET)
    ids = [name for name in counted.columns if name not in _VALUES]

    def write(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, out)
        fresh = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = buckets_of(fresh.select(day))
            known = table.rows(table.commit(batch_id), fresh.schema, touched)
            either = known.select("*", F.lit(0).alias("_at")).unionByName(fresh.select("*", F.lit(1).alias("_at")))
            newest = either.groupBy(*ids).agg(F.max_by(F.struct(*_VALUES), "_at").alias("v")).select(day, *ids, "v.*")
            table.write(batch_id, newest.select(BUCKET, *counted.columns), touched, {})
        finally:
            fresh.unpersist()

    return counted.writeStream.outputMode("update").foreachBatch(write)


def current_counters(spark: SparkSession, out: str, counted: DataFrame) -> DataFrame:
    """The newest values of every window, in the columns of ``counted``."""
    table = StateTable(spark, out)
    return table.rows(table.commit(), counted.schema)


def append_closed(counted: DataFrame, out: str) -> DataStreamWriter:
    """Append each window once, when the watermark has passed its end."""
    return counted.writeStream.outputMode("append").format("parquet").option("path", out)


def session_updates(rows: DataFrame, out: str, gap: str, keys: list[str], delay: str) -> DataStreamWriter:
    """Sessions as they grow: open ones in the state, closed ones told once.

    Spark's own session windows tell a session only when it has closed. Here a batch's sessions
    meet the open ones of their keys in the state; those that overlap become one, which
    replaces them, also where a late row joins two. A session closes when the watermark
    (newest time of the batches before, less ``delay``) has passed its end; rows whose session
    could only be a closed one are late and dropped, as Spark does.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = StateTable(spark, f"{out}/open")
        before = table.commit(batch_id)
        watermark = before.values.get("watermark")
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            timely = held if watermark is None else held.where(micros(F.col("at") + F.expr(f"INTERVAL {gap}")) > watermark)
            fresh = _parts(timely, gap, keys)
            newest = held.agg(F.max(micros(F.col("at") - F.expr(f"INTERVAL {delay}")))).first()[0]
            passed = max((x for x in (newest, watermark) if x is not None), default=None)
            # All buckets: a session may close without a row of its key.
            touched = sorted(set(before.written) | set(buckets_of(timely.select(hashed(keys)))))
            known = table.rows(before, fresh.schema)
            merged = _merged(known.unionByName(fresh), keys).persist(StorageLevel.MEMORY_AND_DISK)
            closed = F.lit(False) if watermark is None else micros(F.col("window_end")) <= watermark
            merged.where(closed).write.mode("overwrite").parquet(f"{out}/closed/batch={batch_id}")
            table.write(batch_id, merged.where(~closed).select(hashed(keys), "*"), touched, {"watermark": passed})
            merged.unpersist()
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(update)


def _parts(rows: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Sessions within one batch, with exact total latency."""
    return rows.groupBy(F.session_window("at", gap).alias("w"), *keys).agg(
        F.min("at").alias("window_start"), (F.max("at") + F.expr(f"INTERVAL {gap}")).alias("window_end"),
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("kind") == "error").alias("errors"),
        F.sum(F.col("latency_ms").cast("decimal(18,4)")).alias("latency_ms"),
    ).drop("w")


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions that overlap as one."""
    order = Window.partitionBy(*keys).orderBy("window_start", "window_end")
    reach = F.max("window_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("window_start") < reach, 0).otherwise(1)
    numbered = parts.withColumn("_new", begins).withColumn("_nr", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_nr").agg(
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
        F.sum("latency_ms").cast("decimal(28,4)").alias("latency_ms"),
    ).drop("_nr").select(*keys, "window_start", "window_end", "requests", "errors", "latency_ms")


def all_sessions(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """Closed sessions and those still open; ``schema`` is that of the keys."""
    full = spark.createDataFrame(
        [], f"{schema}, window_start timestamp, window_end timestamp, requests bigint, errors bigint, latency_ms decimal(28,4)"
    ).schema
    table = StateTable(spark, f"{out}/open")
    both = spark.read.schema(full).parquet(f"{out}/closed").drop("batch").unionByName(table.rows(table.commit(), full))
    return both.select(
        *[F.col(name).cast("timestamp_ntz").alias(name) for name in ("window_start", "window_end")],
        *keys, "requests", "errors", F.col("latency_ms").cast("double").alias("latency_ms"),
    )
