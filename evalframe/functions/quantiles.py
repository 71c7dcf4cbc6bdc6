"""Exact interpolated quantiles that never hold a group's values in one buffer or task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.session import shared_path

_ACCURACY = 10_000
_MARGIN = 5 / _ACCURACY
_BINS = 1_024


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], also: dict[str, Column] | None = None
) -> DataFrame:
    """Keys, ``n`` and one decimal column per named probability, in two scans of ``df``.

    A mergeable sketch first brackets each quantile to about a thousandth of its group.
    Values below the bracket are only counted and values above are not needed. Those
    inside fall into equal bins; counts per bin tell which one or two bins hold the
    quantile, and only their values are put in order. Equal values are combined before
    every shuffle. Groups smaller than the sketch's resolution are binned whole. Nulls
    and NaN are left out. The sketch pass runs when this is called; the aggregates ``also``
    take part in it, over all rows, and keep groups in which no value is left.
    """
    wanted = list(probs.items())
    edges = []
    for _, p in wanted:
        edges += [max(0.0, p - _MARGIN), min(1.0, p + _MARGIN)]
    valid = F.when(_valid(value), F.col(value))
    brackets = df.groupBy(*keys).agg(
        F.count(valid).alias("n"),
        F.percentile_approx(valid, edges, _ACCURACY).alias("_edges"),
        F.min(valid).alias("_min"),
        F.max(valid).alias("_max"),
        *[aggregate.alias(name) for name, aggregate in (also or {}).items()],
    )
    # Written first, the brackets have a known size: Spark broadcasts them only when they
    # are small, and does not shuffle all rows before it can tell.
    path = shared_path(df.sparkSession, "brackets")
    brackets.write.parquet(path)
    known = df.sparkSession.read.parquet(path)
    points = refined(df, known.where("n > 0"), keys, value, probs)
    if not also:
        return points
    others = [f"_point{i}" for i in range(len(keys))]
    points = points.drop("n").withColumnsRenamed(dict(zip(keys, others)))
    return known.join(points, _same(keys, others), "left").select(*keys, "n", *probs, *also)


def _valid(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def refined(df: DataFrame, brackets: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Keys, ``n`` and the exact quantiles, in one scan of ``df``.

    ``brackets`` have keys, the number ``n`` of values, their ``_min`` and ``_max``, and in
    ``_edges`` two values for each probability that hold its quantile.
    """
    clean = df.where(_valid(value)).select(*keys, value)
    wanted = list(probs.items())
    small = F.col("n") <= _ACCURACY
    others = [f"_key{i}" for i in range(len(keys))]
    asked = brackets.select(*[F.col(k).alias(o) for k, o in zip(keys, others)], "n", F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("which"),
            (F.lit(p) * (F.col("n") - 1)).alias("rank"),
            F.when(small, F.col("_min")).otherwise(F.col("_edges")[2 * i]).alias("low"),
            F.when(small, F.col("_max")).otherwise(F.col("_edges")[2 * i + 1]).alias("high"),
        )
        for i, (_, p) in enumerate(wanted)
    ])).alias("q")).select(*others, "n", "q.*")

    v, low = F.col(value), F.col("low")
    width = F.col("high").cast("double") - low.cast("double")
    place = F.floor((v.cast("double") - low.cast("double")) / width * _BINS)
    spread = (width > 0) & (width < float("inf"))
    cells = (
        clean.join(asked, _same(keys, others))
        .where(v <= F.col("high"))
        .groupBy(
            *keys, "which", "n", "rank",
            F.when(v < low, -1).when(spread, place).otherwise(0).cast("int").alias("_bin"),
            F.when(v >= low, v).alias("_cell"),
        )
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    group = [*keys, "which", "n", "rank"]
    lower, upper = F.floor("rank"), F.ceil("rank")
    start = F.sum("_b").over(Window.partitionBy(*keys, "which").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = cells.groupBy(*group, "_bin").agg(F.sum("_c").alias("_b")).withColumn("_start", F.coalesce(start, F.lit(0)))

    def inside(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_b"))

    hits = bins.where(inside(lower) | inside(upper)).select(
        *[F.col(k).alias(o) for k, o in zip(keys, others)],
        F.col("which").alias("_which"), F.col("_bin").alias("_hit"), "_start",
    )
    ordered = Window.partitionBy(*keys, "which", "_bin").orderBy("_cell")
    ranked = cells.join(hits, _same([*keys, "which", "_bin"], [*others, "_which", "_hit"])).withColumn(
        "_upto", F.col("_start") + F.sum("_c").over(ordered)
    )
    picked = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("_upto") > lower, F.col("_cell"))).cast("double").alias("_lo"),
        F.min(F.when(F.col("_upto") > upper, F.col("_cell"))).cast("double").alias("_hi"),
        F.min("_bin").alias("_first"),
    )
    # A quantile outside its bracket would be wrong; it stops the job instead.
    sound = (F.col("_first") >= 0) & F.col("_hi").isNotNull()
    mixed = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("rank") - lower)
    point = F.when(sound, mixed.cast("decimal(24,6)")).otherwise(
        F.raise_error(F.lit("quantile outside its bracket")).cast("decimal(24,6)")
    )
    return picked.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("which") == i, point)).alias(name) for i, (name, _) in enumerate(wanted)
    ])
