"""Telemetry over tables of many systems."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions import fixed_values as fixed
from evalframe.functions.times import iso_utc, micros, parse_iso
from evalframe.operators.ordered import TARGET_ROWS, last_known, next_time
from evalframe.session import shared_path

def activity_snapshot(commits: DataFrame, asof: Column, days: int = fixed.ACTIVITY_WINDOW_DAYS) -> DataFrame:
    """Commits in all, commits in the trailing window, and the newest commit per system."""
    since = asof - F.expr(f"INTERVAL {days} DAYS")
    return commits.where(F.col("commit_at") <= asof).groupBy("system").agg(
        F.count(F.lit(1)).alias("commits_total"),
        F.count_if(F.col("commit_at") >= since).alias("commits_30d"),
        F.max("commit_at").alias("last_commit_at"),
    )


def capped(name: Column, value: Column) -> Column:
    """Value held to its metric's cap; no lower bound, unknown names and nulls pass."""
    cap = F
    for metric, most in fixed.SAFETY_CAPS.items():
        cap = cap.when(name == metric, F.lit(most).cast("bigint"))
    return F.when(value > cap, cap).otherwise(value)


def clamp_metrics(long: DataFrame) -> DataFrame:
    """Add ``capped`` to a (metric, value) table. The caps are literals: no join."""
    return long.withColumn("capped", capped(F.col("metric"), F.col("value")))


def long_metrics(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(ids, metrics, "metric", "value")


def _last_page(link: Column) -> Column:
    digits = F.nullif(F.regexp_extract(link, fixed.LAST_PAGE_PATTERN, 1), F.lit(""))
    # A number too long for bigint is still only a number above every cap.
    return F.when(digits.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1)))


def page_total(link: Column, body: Column) -> Column:
    """Record count of a one-per-page listing; null for a body that is not an array."""
    return F.coalesce(_last_page(link), F.json_array_length(body).cast("bigint"))


def pagination_totals(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("kind") != "repo").select(
        "system", "kind", page_total(F.col("link"), F.col("body")).alias("total")
    )


def parsed_pages(pages: DataFrame, *keys: Column) -> DataFrame:
    """Each page's content in columns: ``repo`` of a repository page, ``total`` and ``newest`` of
    a listing. All are null for a page that is not JSON or not of the expected shape.
    """
    kind, listing = F.col("kind"), F.col("kind").isin("latest", "recent")
    # Each body is parsed once per row, into columns, before rows meet.
    repo = F.from_json("body", "stargazers_count bigint, language string, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return pages.select(
        "system", "kind", "link", "body", *keys,
        F.when(kind == "repo", repo).alias("_repo"),
        F.when(listing, F.json_array_length("body")).alias("_length"),
        F.when(kind == "latest", F.get_json_object("body", "$[0].commit.author.date")).alias("newest"),
    ).drop("body").withColumns({
        "repo": F.when(F.col("_repo").isNotNull() & F.col("_repo._broken").isNull(), F.struct("_repo.stargazers_count", "_repo.language")),
        "total": F.when(F.col("_length").isNotNull(), F.coalesce(_last_page(F.col("link")), F.col("_length").cast("bigint"))),
    }).drop("link", "_repo", "_length")


def metrics_of(gathered: DataFrame, *keys: str) -> DataFrame:
    """The metrics row of harvests with ``repo, total, recent, newest``.

    The harvest has failed (``ok`` false) when a page is missing, is not JSON, is not of
    the expected shape, or holds a count of another type.
    """
    ok = F.col("repo").isNotNull() & F.col("total").isNotNull() & F.col("recent").isNotNull()

    def metric(name: str, value: Column) -> Column:
        return F.when(ok, capped(F.lit(name), value)).otherwise(F.lit(0).cast("bigint")).alias(name)

    language = F.coalesce(F.nullif(F.col("repo.language"), F.lit("")), F.lit(fixed.UNKNOWN))
    return gathered.select(
        *keys,
        ok.alias("ok"),
        F.when(ok, "operational").otherwise("degraded").alias("status"),
        metric("commits_30d", F.col("recent")),
        metric("commits_total", F.col("total")),
        metric("repo_stars", F.coalesce("repo.stargazers_count", F.lit(0).cast("bigint"))),
        F.when(ok, language).otherwise(fixed.UNKNOWN).alias("primary_language"),
        F.when(ok, F.col("newest")).alias("last_commit_at"),
    )


def harvest(pages: DataFrame) -> DataFrame:
    """One metrics row per system out of its repo, latest and recent pages, one of each.

    Pages of several harvests are put together by ``harvests.assemble``.
    """
    only = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    gathered = parsed_pages(pages).groupBy("system").agg(
        F.max("repo").alias("repo"), only("latest", "total").alias("total"), only("recent", "total").alias("recent"),
        only("latest", "newest").alias("newest"),
    )
    return metrics_of(gathered, "system")


def with_snapshot(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add ``lines_of_code`` from the build snapshot where it is above zero."""
    known = snapshot.where(F.col("lines_of_code") > 0).select(
        "system", capped(F.lit("lines_of_code"), F.col("lines_of_code")).alias("lines_of_code")
    )
    return rows.join(known, "system", "left")


def envelope_json(harvested: DataFrame, generated_at: Column, deployed_at: Column, mode: str = "showcase") -> DataFrame:
    """The JSON edge: unknown metrics are left out, unknown times stay as null."""
    metrics = F.to_json(F.struct("commits_30d", "commits_total", "lines_of_code", "primary_language", "repo_stars"))
    body = F.struct(
        F.col("system").cast("string").alias("system"),
        F.lit(mode).alias("mode"),
        "status",
        iso_utc(deployed_at).alias("last_deployed_at"),
        "last_commit_at",
        F.parse_json(metrics).alias("metrics"),
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
        iso_utc(generated_at).alias("generated_at"),
    )
    return harvested.select("system", F.to_json(body, {"ignoreNullFields": "false"}).alias("envelope"))


def resolve_status(observed: DataFrame, fetched_at: str = "at", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Status and served value per observation: a failure serves the last good value.

    A failed poll, and a null or NaN value, count as failed; before the first good one,
    zero is served. ``fetched_at`` names the time reported for a good value.
    """
    good = F.coalesce(F.col("ok") & ~F.isnan("value"), F.lit(False)) & F.col("value").isNotNull()
    kept = F.struct(F.col("value").alias("value"), F.col(fetched_at).alias("at"))
    seen = last_known(observed, "system", "at", "id", good, kept, "_last", target_rows=target_rows)
    return seen.select(
        "system", "at", "id",
        F.when(good, "operational").otherwise("degraded").alias("status"),
        F.coalesce(F.col("_last.value"), F.lit(0.0)).alias("served_value"),
        F.col("_last.at").alias("last_good_at"),
    )


def contract_violations(envelopes: DataFrame) -> DataFrame:
    """One row per broken rule of each envelope; a narrow pass, nothing shuffles."""
    def broken(rule: str, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(rule))

    rules = [
        broken("system_missing", F.col("system").isNull() | (F.col("system") == "")),
        broken("status_enum", F.col("status").isNull() | ~F.col("status").isin(*fixed.STATUSES)),
        broken("mode_enum", ~F.col("mode").isin(*fixed.MODES)),
        broken("schema_version", ~F.col("schema_version").eqNullSafe(fixed.SCHEMA_VERSION)),
        broken("generated_at_zone", F.col("generated_at").isNull() | ~F.col("generated_at").endswith("Z")),
    ]
    for name in ("generated_at", "last_commit_at", "last_deployed_at"):
        rules.append(broken(f"{name}_unreadable", F.col(name).isNotNull() & parse_iso(F.col(name)).isNull()))
    for name, cap in fixed.SAFETY_CAPS.items():
        rules.append(broken(f"{name}_above_cap", F.col(name) > cap))
        rules.append(broken(f"{name}_negative", F.col(name) < 0))
    # Exploded whole and filtered after: both stay in generated code, a lambda would not.
    found = F.explode(F.array(*rules))
    return envelopes.select("id", "system", found.alias("rule")).where(F.col("rule").isNotNull())


def line_count(text: Column) -> Column:
    """Lines ended by a newline, plus an unterminated last one."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends.cast("bigint") + ((text != "") & ~text.endswith("\n")).cast("bigint")


def suffix_of(path: Column) -> Column:
    """Last extension of the file name, as written; '' for none or a bare dot name."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def is_counted(path: Column) -> Column:
    """Whether a path has a source suffix and lies in no excluded folder."""
    outside = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, fixed.EXCLUDED_FOLDERS)))
    return F.coalesce(suffix_of(path).isin(*fixed.SOURCE_SUFFIXES) & outside, F.lit(False))


def counted_files(files: DataFrame, skip_paths: Iterable[str] = ()) -> DataFrame:
    """Files with a source suffix outside the excluded folders, with their line counts."""
    path = F.col("path")
    kept = files.where(is_counted(path))
    skipped = list(skip_paths)
    if skipped:
        kept = kept.where(~path.isin(*skipped))
    return kept.withColumn("suffix", suffix_of(path)).withColumn("lines", line_count(F.col("text"))).drop("text")


def code_of_systems(files: DataFrame, skip_paths: Iterable[str] = ()) -> DataFrame:
    """Counted lines per system and the language that most of them are in, ties to the later name."""
    by_language = counted_files(files, skip_paths).groupBy("system", "language").agg(F.sum("lines").alias("lines"))
    known = F.when(F.col("language").isNotNull(), F.struct("lines", "language"))
    return by_language.groupBy("system").agg(
        F.sum("lines").alias("lines_of_code"), F.max(known)["language"].alias("primary_language")
    )


def lines_of_code(files: DataFrame, skip_paths: Iterable[str] = ()) -> DataFrame:
    """Files and lines per suffix, and in all."""
    by_suffix = counted_files(files, skip_paths).groupBy("suffix").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")
    )
    # Rolled up after the first grouping, so only a handful of rows is doubled.
    return by_suffix.rollup("suffix").agg(
        F.sum("files").alias("files"), F.sum("lines").alias("lines"), F.grouping("suffix").alias("_all")
    ).select(F.when(F.col("_all") == 1, "(all)").otherwise(F.col("suffix")).alias("suffix"), "files", "lines")


def snapshot_lines(files: DataFrame, path: str | None = None) -> DataFrame:
    """Lines per system as a written build snapshot, one row per system.

    Like any built artifact it is made once. Its size is then known, so joins broadcast it
    only when it is small, and need no shuffle of the rows to find out.
    """
    spark = files.sparkSession
    path = path or shared_path(spark, "snapshot")
    counted_files(files).groupBy("system").agg(F.sum("lines").alias("lines_of_code")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def primary_language(files: DataFrame) -> DataFrame:
    """The language with most counted lines per system, ties to the later name."""
    counted = is_counted(F.col("path"))
    by_language = files.select(
        "system", F.when(counted, F.col("language")).alias("language"),
        F.when(counted, line_count(F.col("text"))).otherwise(0).alias("lines"),
    ).groupBy("system", "language").agg(F.sum("lines").alias("lines"))
    known = F.when(F.col("language").isNotNull(), F.struct("lines", "language"))
    return by_language.groupBy("system").agg(F.max(known).alias("_top")).select(
        "system",
        F.coalesce(F.col("_top.language"), F.lit(fixed.UNKNOWN)).alias("primary_language"),
        F.coalesce(F.col("_top.lines"), F.lit(0).cast("bigint")).alias("language_lines"),
    )


def header_label(status: Column, reachable: Column) -> Column:
    """Words beside the header badge; ``down`` is shown as offline."""
    return (
        F.when(status == "operational", "Operational").when(status == "degraded", "Degraded")
        .when((status == "down") | ~reachable, "Offline").otherwise("Connecting")
    )


def tones(status: Column, reachable: Column) -> dict[str, Column]:
    """Badge tone per place it is shown; the header also marks ``down`` as danger."""
    fine, warned = status == "operational", status == "degraded"
    return {
        "header": F.when(fine, "success").when(warned, "warning")
        .when((status == "down") | ~reachable, "danger").otherwise("muted"),
        "overview": F.when(fine, "success").otherwise("warning"),
        "telemetry": F.when(fine, "success").when(warned, "warning").otherwise("muted"),
    }


def status_board(reports: DataFrame) -> DataFrame:
    """Systems per tone and place, from each system's latest report."""
    latest = reports.groupBy("system").agg(
        F.max_by(F.struct("status", "reachable"), F.struct("at", "id")).alias("now")
    )
    status, reachable = F.col("now.status"), F.col("now.reachable")
    shown = F.explode(F.array(*[
        F.struct(
            F.lit(place).alias("place"), tone.alias("tone"),
            (header_label(status, reachable) if place == "header" else F.lit(None).cast("string")).alias("label"),
        )
        for place, tone in tones(status, reachable).items()
    ]))
    return latest.select(shown.alias("s")).groupBy("s.place", "s.tone", "s.label").agg(
        F.count(F.lit(1)).alias("systems")
    )


def offline_gaps(
    observed: DataFrame, missed_polls: int, asof: Column, poll_seconds: int = fixed.POLL_SECONDS
) -> DataFrame:
    """Stretches without any observation longer than ``missed_polls`` poll intervals.

    A system still silent at ``asof`` has no ``back_at``; its silence is counted to then.
    """
    limit_us = missed_polls * poll_seconds * 1_000_000
    seen = next_time(observed.select("system", "at", "id"), "system", "at", "id", "_next")
    gap_us = micros(F.coalesce(F.col("_next"), asof)) - micros(F.col("at"))
    return seen.where(gap_us > limit_us).select(
        "system", F.col("at").alias("last_seen"), F.col("_next").alias("back_at"),
        F.floor(gap_us / 1_000_000).cast("bigint").alias("silent_s"),
    )
