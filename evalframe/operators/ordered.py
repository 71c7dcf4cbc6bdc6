"""Ordered look-back and look-ahead over keys that may hold most of the rows.

A window partitioned by the key alone puts a hot key into one task. Here every key is cut
into time chunks: hours, minutes where an hour of one key holds more than ``target_rows``,
and even parts of a minute that is still too full. Chunk edges are summarised to one row
each, the small summary carries values across chunks, and the row-level window only ever
sees one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.times import micros

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
TARGET_ROWS = 2_000_000


def _overfull(timed: DataFrame, key: str, cell: str, target_rows: int) -> DataFrame:
    """Cells of a key with more than ``target_rows`` rows, and the parts they need.

    Counts combine before the shuffle. There are at most rows / target_rows such cells, a
    few megabytes per trillion rows, so broadcasting them is bounded. A broadcast also
    runs first: rows are not shuffled just to find that no cell is overfull.
    """
    counted = timed.groupBy(key, cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
    return F.broadcast(counted.select(key, cell, F.ceil(F.col("_n") / target_rows).cast("bigint").alias("_parts")))


def with_chunks(df: DataFrame, key: str, ts: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``_chunk``, a bigint that rises with time within each key."""
    timed = df.withColumn("_us", micros(F.col(ts))).withColumns({
        "_hour": F.expr(f"_us - pmod(_us, {HOUR_US})"), "_minute": F.expr(f"_us - pmod(_us, {MINUTE_US})"),
    })
    hours = _overfull(timed, key, "_hour", target_rows).withColumnRenamed("_parts", "_full")
    minutes = _overfull(timed.join(F.broadcast(hours), [key, "_hour"], "left_semi"), key, "_minute", target_rows)
    part = F.expr(f"((_us - _minute) * coalesce(_parts, 1L)) div {MINUTE_US}")
    width = F.expr(f"{MINUTE_US} div coalesce(_parts, 1L)")
    return (
        timed.join(F.broadcast(hours), [key, "_hour"], "left").join(minutes, [key, "_minute"], "left")
        .withColumn("_chunk", F.when(F.col("_full").isNull(), F.col("_hour")).otherwise(F.col("_minute") + part * width))
        .drop("_us", "_hour", "_minute", "_parts", "_full")
    )


def _with_edges(chunked: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Join one edge row per chunk to the chunk's rows.

    The row-level window has already shuffled and sorted by (key, chunk), so the join
    adds no shuffle of rows, and hashing the edges adds no sort.
    """
    return chunked.join(edges.hint("shuffle_hash"), [key, "_chunk"], "left")


def last_known(
    df: DataFrame, key: str, ts: str, tie: str, good: Column, payload: Column, out: str,
    before: bool = False, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``out``: the payload of the latest good row at or before each row.

    ``before=True`` leaves the row itself out. ``tie`` makes the order of equal times
    total. Rows before the first good row get null.
    """
    chunked = with_chunks(df, key, ts, target_rows)
    order = F.struct(F.col(ts), F.col(tie))
    tails = chunked.groupBy(key, "_chunk").agg(F.max_by(payload, F.when(good, order)).alias("_tail"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(key, "_chunk", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    here = (
        Window.partitionBy(key, "_chunk").orderBy(ts, tie)
        .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    )
    local = F.last(F.when(good, payload), ignorenulls=True).over(here)
    return (
        _with_edges(chunked.withColumn("_local", local), carried, key)
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_chunk", "_carry", "_local")
    )


def next_time(
    df: DataFrame, key: str, ts: str, tie: str, out: str, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add ``out``: the time of the key's following row, null on its last row."""
    chunked = with_chunks(df, key, ts, target_rows)
    heads = chunked.groupBy(key, "_chunk").agg(F.min(ts).alias("_head"))
    later = Window.partitionBy(key).orderBy("_chunk")
    ahead = heads.select(key, "_chunk", F.lead("_head").over(later).alias("_ahead"))
    local = F.lead(ts).over(Window.partitionBy(key, "_chunk").orderBy(ts, tie))
    return (
        _with_edges(chunked.withColumn("_local", local), ahead, key)
        .withColumn(out, F.coalesce("_local", "_ahead"))
        .drop("_chunk", "_ahead", "_local")
    )
