"""Streams of observations: ingest, last known good, latest state, offline alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evalframe.functions.fixed_values import POLL_SECONDS
from evalframe.functions.times import micros
from evalframe.operators.harvests import METRICS, served_columns
from evalframe.operators.ordered import last_known
from evalframe.operators.telemetry import offline_gaps
from evalframe.streaming.state import BUCKET, StateTable, buckets_of, hashed

_EPOCH = "1970-01-01 00:00:00"
_SEED = -(2**63)


def ingest(stream: DataFrame, out: str) -> DataStreamWriter:
    """Append observations to a table as they arrive."""
    return stream.writeStream.format("parquet").option("path", out).outputMode("append")


def _version(folder: str, batch_id: int) -> str:
    return f"{folder}/version={batch_id}"


def _each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Run ``work`` per micro-batch; its several reads of the batch share one scan."""
    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            work(held, batch_id)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run)


def _carried(
    stream: DataFrame, out: str, state: str, good: Column, row: Column, shown: Callable[[Column, Column], list[Column]]
) -> DataStreamWriter:
    """Serve each row the last good ``row`` of its system, carried between batches.

    The state has one row per system. Rows of the batch's systems seed the batch operator,
    which splits hot systems by time. Re-running a batch starts from the same commit and
    rewrites the same folders, so a restart repeats nothing.
    """
    def resolve(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, state)
        rows = batch.select("system", "at", "id", F.coalesce(good, F.lit(False)).alias("_good"), F.when(good, row).alias("_row"))
        fresh = rows.where("_good").groupBy("system").agg(
            F.max_by("_row", F.struct("at", "id")).alias("_row"), F.max(F.struct("at", "id")).alias("_newest")
        ).select(hashed(["system"]), "*")
        before = table.commit(batch_id)
        known = table.rows(before, fresh.drop(BUCKET).schema, buckets_of(rows.select(hashed(["system"]))))
        # Seeds sort before every row of the batch: a late row still sees what was known.
        seeds = known.join(rows.select("system").distinct(), "system", "left_semi").select(
            "system", F.lit(_EPOCH).cast("timestamp").alias("at"), F.lit(_SEED).alias("id"), F.lit(True).alias("_good"), "_row"
        )
        seen = last_known(rows.unionByName(seeds), "system", "at", "id", F.col("_good"), F.col("_row"), "_last")
        served = seen.where(F.col("id") != _SEED).select("system", "at", "id", *shown(F.col("_good"), F.col("_last")))
        served.write.mode("overwrite").parquet(_version(out, batch_id))
        touched = buckets_of(fresh)
        kept = table.rows(before, fresh.drop(BUCKET).schema, touched).select(hashed(["system"]), "*")
        newest = kept.unionByName(fresh).groupBy(BUCKET, "system").agg(
            F.max_by("_row", "_newest").alias("_row"), F.max("_newest").alias("_newest")
        )
        table.write(batch_id, newest, touched, {})

    return _each_batch(stream, resolve)


def last_known_good(stream: DataFrame, out: str, state: str) -> DataStreamWriter:
    """Status resolution per micro-batch of single values."""
    good = F.coalesce(F.col("ok") & ~F.isnan("value"), F.lit(False)) & F.col("value").isNotNull()
    return _carried(
        stream, out, state, good, F.struct(F.col("value").alias("value"), F.col("at").alias("at")),
        lambda ok, last: [
            F.when(ok, "operational").otherwise("degraded").alias("status"),
            F.coalesce(last["value"], F.lit(0.0)).alias("served_value"), last["at"].alias("last_good_at"),
        ],
    )


def last_good_metrics(stream: DataFrame, out: str, state: str) -> DataStreamWriter:
    """Status resolution per micro-batch of whole metrics rows: one harvest per row."""
    return _carried(stream, out, state, F.col("ok"), F.struct(*METRICS, F.col("at").alias("at")), served_columns)


def served_rows(spark: SparkSession, out: str) -> DataFrame:
    """All rows written by ``last_known_good`` or ``last_good_metrics``."""
    return spark.read.parquet(out).drop("version")


def latest_per_system(observed: DataFrame) -> DataFrame:
    """Newest poll and newest good value per system; a failed poll erases nothing."""
    good = F.when(F.col("ok"), F.struct("at", "id"))
    return observed.groupBy("system").agg(
        F.max("at").alias("last_poll_at"),
        F.max_by("ok", F.struct("at", "id")).alias("last_ok"),
        F.max(good["at"]).alias("data_at"),
        F.max_by("id", good).alias("data_id"),
        F.max_by("value", good).alias("data_value"),
    )


def upsert_latest(stream: DataFrame, state: str) -> DataStreamWriter:
    """Keep the latest-per-system table up to date; a batch rewrites its systems' buckets."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, state)
        fresh = latest_per_system(batch)
        touched = buckets_of(fresh.select(hashed(["system"])))
        merged = merge_latest(fresh, table.rows(table.commit(batch_id), fresh.schema, touched))
        table.write(batch_id, merged.select(hashed(["system"]), "*"), touched, {})

    return _each_batch(stream, upsert)


def merge_latest(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per system out of two latest-per-system tables."""
    data = F.when(F.col("data_at").isNotNull(), F.struct("data_at", "data_id"))
    return left.unionByName(right).groupBy("system").agg(
        F.max("last_poll_at").alias("last_poll_at"),
        F.max_by("last_ok", "last_poll_at").alias("last_ok"),
        F.max("data_at").alias("data_at"),
        F.max_by("data_id", data).alias("data_id"),
        F.max_by("data_value", data).alias("data_value"),
    )


_LATEST = "system bigint, last_poll_at timestamp, last_ok boolean, data_at timestamp, data_id bigint, data_value double"
_SEEN = "system bigint, last_seen timestamp"


def _schema(spark: SparkSession, text: str):
    return spark.createDataFrame([], text).schema


def latest_version(spark: SparkSession, state: str, schema: str = _LATEST) -> DataFrame:
    """The rows of a state table after its newest batch."""
    table = StateTable(spark, state)
    return table.rows(table.commit(), _schema(spark, schema))


def offline_alerts(stream: DataFrame, out: str, state: str, missed_polls: int) -> DataStreamWriter:
    """Tell silences longer than ``missed_polls`` poll intervals: while they last, and as they end.

    The clock of the stream is the newest time of any system. Whenever it moves, every system
    whose silence has passed the limit since the batch before is told at once (``raised``), with
    no need of a further row of that system. The state has each system's newest time; a
    batch rewrites its own systems and reads the times of the others, of which only those that the
    clock has just passed come through the filter.

    The state stands before the batch's rows, so an ended silence is found whether it lies within
    a batch or between two, and the same rows give the same ended silences in any number of
    batches. A row older than the newest time known before its batch is late; it takes back no
    silence already told.
    """
    limit_us = missed_polls * POLL_SECONDS * 1_000_000

    def watch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = StateTable(spark, state)
        before = table.commit(batch_id)
        rows = batch.select("system", "at", "id")
        seen = _schema(spark, _SEEN)
        touched = buckets_of(rows.select(hashed(["system"])))
        known = table.rows(before, seen, touched)
        seeds = known.join(rows.select("system").distinct(), "system", "left_semi")
        late = F.coalesce(F.col("at") < F.col("last_seen"), F.lit(False))
        timely = rows.join(known, "system", "left").where(~late).select("system", "at", "id").unionByName(
            seeds.select("system", F.col("last_seen").alias("at"), F.lit(_SEED).alias("id"))
        )
        # Open silences are raised below and follow from the state; here are those with an end.
        ended = offline_gaps(timely, missed_polls, F.lit(None).cast("timestamp"))
        ended.write.mode("overwrite").parquet(_version(f"{out}/ended", batch_id))

        fresh = batch.groupBy("system").agg(F.max("at").alias("last_seen"))
        newest = fresh.unionByName(known).groupBy("system").agg(F.max("last_seen").alias("last_seen"))
        last_clock = before.values.get("clock")
        moved = batch.agg(F.max(micros(F.col("at")))).first()[0]
        clock = max((x for x in (moved, last_clock) if x is not None), default=None)
        table.write(batch_id, newest.select(hashed(["system"]), "*"), touched, {"clock": clock})
        if clock is None:
            return
        now = table.rows(table.commit(batch_id + 1), seen)
        past = lambda at: micros(F.col("last_seen")) < at - limit_us
        raised = now.where(past(clock))
        if last_clock is not None:
            # What the clock has passed since the batch before, and news that come overdue.
            news = newest.join(known, ["system", "last_seen"], "left_anti")
            raised = now.where(past(clock) & ~past(last_clock)).unionByName(news.where(past(last_clock)))
        raised = raised.withColumn("raised_at", F.timestamp_micros(F.lit(clock)))
        raised.write.mode("overwrite").parquet(_version(f"{out}/raised", batch_id))

    return _each_batch(stream, watch)


def raised_alerts(spark: SparkSession, out: str) -> DataFrame:
    """``system, last_seen, raised_at`` of every silence told while it lasted."""
    return spark.read.schema(f"{_SEEN}, raised_at timestamp").parquet(f"{out}/raised").drop("version")


def silences(spark: SparkSession, out: str, state: str, missed_polls: int, asof: Column) -> DataFrame:
    """All silences told by ``offline_alerts`` and those still open at ``asof``."""
    ended = spark.read.parquet(f"{out}/ended").drop("version")
    still = offline_gaps(
        latest_version(spark, state, _SEEN).select("system", F.col("last_seen").alias("at"), F.lit(_SEED).alias("id")),
        missed_polls, asof,
    )
    return ended.unionByName(still)
