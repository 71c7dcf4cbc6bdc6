"""Comparing runs: classes of change, regressions, history, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.rubrics import GRID
from evalframe.session import shared_path


def units(score: str = "score") -> Column:
    """Score as a whole number of ten-thousandths, rounded half up."""
    return F.round(F.col(score) * GRID).cast("bigint")


def mean_units(total: Column, n: Column) -> Column:
    """Mean of non-negative whole numbers, rounded half up without floating point."""
    return F.call_function("div", total * 2 + n, F.when(n > 0, n * 2))


def case_means(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trials averaged to one score per key, in ten-thousandths; null scores left out."""
    sums = scores.groupBy(*keys).agg(F.sum(units()).alias("_t"), F.count("score").alias("_n"))
    return sums.select(*keys, mean_units(F.col("_t"), F.col("_n")).cast("bigint").alias("units"))


def compare_runs(scores: DataFrame, baseline, candidate, tolerance: float = 0.0, pass_at: float = 0.95) -> DataFrame:
    """One row per case of either run with its class of change.

    Both runs come from one scan and one grouping: each side is a conditional mean, so
    there is no outer join and trials combine before the only shuffle.
    """
    def side(run, name: str) -> list[Column]:
        mine = F.col("run") == run
        return [
            F.sum(F.when(mine, units())).alias(f"_{name}_t"),
            F.count(F.when(mine, F.col("score"))).alias(f"_{name}_n"),
            F.count_if(mine).alias(f"_{name}_rows"),
        ]

    grouped = scores.where(F.col("run").isin(baseline, candidate)).groupBy("case_id").agg(
        *side(baseline, "base"), *side(candidate, "cand")
    )
    base = mean_units(F.col("_base_t"), F.col("_base_n")).cast("bigint")
    cand = mean_units(F.col("_cand_t"), F.col("_cand_n")).cast("bigint")
    slack, bar = round(tolerance * GRID), round(pass_at * GRID)
    both = grouped.select("case_id", base.alias("_b"), cand.alias("_c"), "_base_rows", "_cand_rows")
    b, c = F.col("_b"), F.col("_c")
    change = c - b
    return both.select(
        "case_id",
        (b / F.lit(float(GRID))).alias("base_score"),
        (c / F.lit(float(GRID))).alias("cand_score"),
        (change / F.lit(float(GRID))).alias("delta"),
        F.when(F.col("_base_rows") == 0, "added").when(F.col("_cand_rows") == 0, "removed")
        .when(change.isNull(), "unscored")
        .when(change < -slack, "regressed").when(change > slack, "improved").otherwise("unchanged").alias("change_class"),
        F.coalesce((b >= bar) & (c < bar), F.lit(False)).alias("pass_to_fail"),
    )


def class_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("change_class").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("pass_to_fail").alias("pass_to_fail")
    )


def worst_regressions(compared: DataFrame, slices: DataFrame, candidate, top: int) -> DataFrame:
    """The ``top`` worst regressions of each slice.

    The rank limit is applied by each map task before the shuffle, so a hot slice ships
    only ``top`` rows per task.
    """
    worst = Window.partitionBy("slice").orderBy("delta", "case_id")
    lost = compared.where(F.col("change_class") == "regressed").join(slices, "case_id", "left")
    return lost.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= top).select(
        F.lit(candidate).alias("candidate_run"), "slice", "rank", "case_id", "base_score", "cand_score", "delta"
    )


def export_regressions(regressions: DataFrame, path: str | None = None, fmt: str = "parquet") -> str:
    """Write regressions partitioned by candidate run; returns the folder.

    Exports of other runs that are there already stay.
    """
    path = path or shared_path(regressions.sparkSession, "regressions")
    writer = regressions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("candidate_run")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def read_regressions(spark, path: str, schema, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def run_history(scores: DataFrame, run: Column, pass_at: float) -> DataFrame:
    """Each variant's runs in order: change, best so far and last passing baseline.

    Rows are reduced to one per (variant, run) first; the windows see runs, not trials.
    """
    runs = case_means(scores.withColumn("run_at", run), ["variant", "run_at"])
    ordered = Window.partitionBy("variant").orderBy("run_at")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    u, bar = F.col("units"), round(pass_at * GRID)
    return runs.select(
        "variant", "run_at",
        (u / F.lit(float(GRID))).alias("score"),
        ((u - F.lag("units").over(ordered)) / F.lit(float(GRID))).alias("change"),
        (F.max("units").over(before) / F.lit(float(GRID))).alias("best_before"),
        F.last(F.when(u >= bar, F.col("run_at")), ignorenulls=True).over(before).alias("last_passing_run"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Variants by mean case score; trials are averaged per case first."""
    per_case = case_means(scores, ["variant", "case_id"])
    totals = per_case.groupBy("variant").agg(F.count("units").alias("cases"), F.sum("units").alias("_t"))
    means = totals.select("variant", "cases", mean_units(F.col("_t"), F.col("cases")).cast("bigint").alias("_m"))
    # One row per variant is left here, so a single ordered partition is small.
    place = F.dense_rank().over(Window.orderBy(F.col("_m").desc()))
    return means.select("variant", "cases", (F.col("_m") / F.lit(float(GRID))).alias("mean_score"), place.alias("place"))


def pairwise_win_rate(scores: DataFrame, variants: Sequence | None = None) -> DataFrame:
    """Wins, ties and losses of each pair of variants on the cases both have.

    A case becomes one sorted array of its variants' scores, and each entry meets those
    after it; pairs are counted by each task before the shuffle. The work of a case is
    quadratic in its own variants, as the result is. Naming variants leaves the rest out.
    """
    known = scores.where(F.col("variant").isNotNull())
    if variants is not None:
        if len(set(variants)) < 2:
            raise ValueError("a comparison needs two variants")
        known = known.where(F.col("variant").isin(*variants))
    cases = case_means(known, ["variant", "case_id"]).where(F.col("units").isNotNull()).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("variant", "units"))).alias("_all")
    )
    first = cases.select("_all", F.posexplode("_all").alias("_i", "_a"))
    pairs = first.select("_a", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("_b"))
    a, b = F.col("_a.units"), F.col("_b.units")
    counted = pairs.groupBy(F.col("_a.variant").alias("variant_a"), F.col("_b.variant").alias("variant_b")).agg(
        F.count_if(a > b).alias("wins"), F.count_if(a == b).alias("ties"), F.count_if(a < b).alias("losses"),
        F.count(F.lit(1)).alias("shared"),
    )
    return counted.withColumn("win_rate", F.col("wins").cast("double") / F.col("shared").cast("double"))
