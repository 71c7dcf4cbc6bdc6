"""Report queries over fleets: utilisation, ages, durations, cards and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions import fixed_values as fixed
from evalframe.functions import formatting as shown
from evalframe.functions.quantiles import exact_quantiles
from evalframe.session import shared_path


def utilisation_report(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Percent of each system's limit in use; ``usage`` has one row per use."""
    # Both sides go through one grouping, so no system is lost for want of a limit or of use.
    sides = usage.select("system", "amount", F.lit(None).cast(limits.schema["limit"].dataType).alias("limit")).unionByName(
        limits.select("system", F.lit(None).cast(usage.schema["amount"].dataType).alias("amount"), "limit")
    )
    joined = sides.groupBy("system").agg(F.sum("amount").alias("used"), F.max("limit").alias("limit"))
    spent = F.coalesce(F.col("used").cast("double"), F.lit(0.0))
    return joined.select(
        "system", spent.alias("used"), F.col("limit"),
        shown.utilisation(spent, F.col("limit")).alias("percent"),
    )


def age_histogram(times: DataFrame, at: Column, asof: Column) -> DataFrame:
    """Rows per age label and feed."""
    aged = times.select("feed", shown.age_unit(at, asof).alias("age"))
    return aged.groupBy("feed", F.col("age.unit").alias("unit"), F.col("age.n").alias("n")).agg(
        F.count(F.lit(1)).alias("rows")
    ).withColumn("label", shown.age_text(F.struct("unit", "n")))


def latency_bands(rows: DataFrame, keys: list[str], ms: str, probs: dict[str, float]) -> DataFrame:
    """Latency quantiles per key with their band and label."""
    found = exact_quantiles(rows, keys, ms, probs)
    out = [F.col(key) for key in keys]
    for name in probs:
        out += [
            F.col(name).cast("double").alias(name),
            shown.duration_band(F.col(name)).alias(f"{name}_band"),
            shown.duration_text(F.col(name)).alias(f"{name}_text"),
        ]
    return found.select(*out)


def band_histogram(rows: DataFrame, ms: str) -> DataFrame:
    """Rows per duration label."""
    value = F.col(ms)
    return rows.groupBy(shown.duration_band(value).alias("band"), shown.duration_text(value).alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def metric_cards(metrics: DataFrame, text_size: int = 24) -> DataFrame:
    """Cards in display order for each system: title, raw value, display and subtitle."""
    def card(position: int, title: str, number: Column | None, display: Column, subtitle: Column) -> Column:
        raw = F.lit(None).cast("bigint") if number is None else number.cast("bigint")
        return F.struct(
            F.lit(position).alias("position"), F.lit(title).alias("title"), raw.alias("raw"),
            display.alias("display"), subtitle.alias("subtitle"),
        )

    def counted(position: int, title: str, name: str, subtitle: Column) -> Column:
        return card(position, title, F.col(name), shown.number_text(F.col(name)), subtitle)

    language = F.col("primary_language")
    mostly = F.coalesce(F.concat(F.lit(fixed.LANGUAGE_SUBTITLE), language), F.lit(fixed.NO_LANGUAGE_SUBTITLE))
    cards = F.explode(F.array(
        counted(1, fixed.COMMITS_TOTAL_TITLE, "commits_total", F.lit("History")),
        counted(2, fixed.COMMITS_30D_TITLE, "commits_30d", F.lit(fixed.COMMITS_30D_SUBTITLE)),
        counted(3, fixed.REPO_STARS_TITLE, "repo_stars", F.lit("Stars")),
        counted(4, fixed.LINES_OF_CODE_TITLE, "lines_of_code", mostly),
        card(5, fixed.PRIMARY_LANGUAGE_TITLE, None, shown.shortened(F.coalesce(language, F.lit(fixed.MISSING)), text_size), F.lit("")),
        card(6, fixed.LAST_COMMIT_TITLE, None, shown.date_text(F.col("last_commit_at")), F.lit("")),
    ))
    return metrics.select("system", cards.alias("card")).select("system", "card.*")


def series_normalised(series: DataFrame) -> DataFrame:
    """Points of (series, at, value) scaled to the unit square; short series are left out.

    Takes one row per period: aggregate raw rows to their period first. Rows are dealt by ranges
    of series and time and written, so that each knows its range; counts, lows and highs of
    the ranges are summed before any row is placed. A row's position is its rank in its range
    after the rows of the ranges before, so a series may be spread over all tasks.
    """
    ranged = series.select("series", "at", "value").repartitionByRange("series", "at").withColumn("_range", F.spark_partition_id())
    path = shared_path(series.sparkSession, "series")
    ranged.write.parquet(path)
    points = series.sparkSession.read.schema(ranged.schema).parquet(path)
    parts = points.groupBy("series", "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    whole = Window.partitionBy("series")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.min("_low").over(whole), F.max("_high").over(whole)
    bounds = parts.select(
        F.col("series").alias("_series"), F.col("_range").alias("_part"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_n"),
        low.alias("_low"), F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)).alias("_span"),
    ).where(F.col("_n") >= 2)
    here = Window.partitionBy("series", "_range").orderBy("at")
    placed = points.withColumn("_i", F.row_number().over(here) - 1).join(
        bounds, F.col("series").eqNullSafe(F.col("_series")) & (F.col("_range") == F.col("_part"))
    )
    return placed.select(
        "series", "at", "value",
        ((F.col("_before") + F.col("_i")).cast("double") / (F.col("_n") - 1).cast("double")).alias("x"),
        ((F.col("value") - F.col("_low")) / F.col("_span")).alias("y"),
    )


def daily_trend(commits: DataFrame, asof: Column, days: int = 10) -> DataFrame:
    """Commits per system for each of the trailing days, zeros included.

    The day counts of a system are columns of one grouped row, so the zeros need no
    calendar join and each map task ships one row per system.
    """
    today = F.to_date(asof)
    back = F.datediff(today, F.to_date("commit_at"))
    counts = commits.where(F.col("commit_at") <= asof).groupBy("system").agg(
        *[F.count_if(back == i).alias(f"_{i}") for i in range(days)]
    )
    points = F.explode(F.array(*[
        F.struct(F.date_format(F.date_sub(today, i), "yyyy-MM-dd").alias("day"), F.col(f"_{i}").alias("commits"))
        for i in reversed(range(days))
    ]))
    return counts.select("system", points.alias("point")).select("system", "point.*")


def trend_direction(commits: DataFrame, asof: Column, days: int = 30) -> DataFrame:
    """Trailing period against the one before it."""
    at, span = F.col("commit_at"), F.expr(f"INTERVAL {days} DAYS")
    counted = commits.where(at <= asof).groupBy("system").agg(
        F.count_if(at >= asof - span).alias("current"),
        F.count_if((at < asof - span) & (at >= asof - span - span)).alias("previous"),
    )
    change = F.col("current") - F.col("previous")
    return counted.select(
        "system", "current", "previous", change.alias("change"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("flat").alias("direction"),
        F.try_divide(change.cast("double") * 100, F.col("previous").cast("double")).alias("change_percent"),
    )
