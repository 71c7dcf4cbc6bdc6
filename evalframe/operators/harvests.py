"""Harvests in time: pages put together as they were fetched, and whole rows carried forward.

A harvest begins with its repository page and takes the listing pages fetched after it, up to
the next repository page and within the time that all calls of a harvest may take. Its metrics
are one row, good or failed as a whole; a failed harvest serves the last good row, never a mix
of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions import fixed_values as fixed
from evalframe.functions.times import micros
from evalframe.operators.ordered import TARGET_ROWS, last_known
from evalframe.operators.telemetry import capped, metrics_of, parsed_pages

METRICS = ("commits_30d", "commits_total", "repo_stars", "primary_language", "last_commit_at")


def assemble(pages: DataFrame, limit_seconds: int = fixed.HARVEST_SECONDS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per harvest out of ``system, id, kind, link, body, fetched_at``.

    ``harvested_at`` and ``harvest_id`` are those of its repository page. Of several pages of a
    kind the last one counts. Pages without a harvest to belong to are left out. ``id`` orders
    pages fetched at the same time.
    """
    begun = F.struct(F.col("fetched_at").alias("at"), F.col("id").alias("id"))
    seen = last_known(
        pages.select("system", "id", "kind", "link", "body", "fetched_at"), "system", "fetched_at", "id",
        F.col("kind") == "repo", begun, "_begun", target_rows=target_rows,
    )
    mine = seen.where(micros(F.col("fetched_at")) - micros(F.col("_begun.at")) <= limit_seconds * 1_000_000)
    parsed = parsed_pages(mine, F.col("_begun.at").alias("harvested_at"), F.col("_begun.id").alias("harvest_id"),
                          F.struct("fetched_at", "id").alias("order"))
    newest = lambda kind, value: F.max_by(value, F.when(F.col("kind") == kind, F.col("order")))
    gathered = parsed.groupBy("system", "harvested_at", "harvest_id").agg(
        newest("repo", "repo").alias("repo"), newest("latest", "total").alias("total"),
        newest("recent", "total").alias("recent"), newest("latest", "newest").alias("newest"),
    )
    return metrics_of(gathered, "system", "harvested_at", "harvest_id")


def serve(harvests: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """What is shown after each harvest: its own row, or the last good one, or zeros.

    The row is carried as one value with the time it was harvested at.
    """
    row = F.struct(*METRICS, F.col("harvested_at").alias("at"))
    seen = last_known(
        harvests.select("system", "harvested_at", "harvest_id", "ok", *METRICS), "system", "harvested_at", "harvest_id",
        F.col("ok"), row, "_row", target_rows=target_rows,
    )
    return seen.select("system", "harvested_at", "harvest_id", *served_columns(F.col("ok"), F.col("_row")))


def served_columns(ok: Column, row: Column) -> list[Column]:
    """Status and metrics shown, given whether the harvest was good and the last good row."""
    zero = lambda name: F.coalesce(row[name], F.lit(0).cast("bigint")).alias(name)
    return [
        F.when(ok, "operational").otherwise("degraded").alias("status"),
        zero("commits_30d"), zero("commits_total"), zero("repo_stars"),
        F.coalesce(row["primary_language"], F.lit(fixed.UNKNOWN)).alias("primary_language"),
        row["last_commit_at"].alias("last_commit_at"), row["at"].alias("last_good_at"),
    ]


def with_lines(served: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add ``lines_of_code`` of the build snapshot, which no failed harvest takes away."""
    known = snapshot.where(F.col("lines_of_code") > 0).select(
        "system", capped(F.lit("lines_of_code"), F.col("lines_of_code")).alias("lines_of_code")
    )
    return served.join(known, "system", "left")
