"""Audit manifests, pseudonymous logs and persisted workload counters."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.quantiles import exact_quantiles, refined
from evalframe.session import files_exist, shared_path

def content_hash(fields: Sequence[str]) -> Column:
    """Hash over fields, each led by its length, with a mark of its own for null."""
    text = [F.col(name).cast("string") for name in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def manifest(artifacts: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(artifact_id, sha256, copies) per distinct content of an artifact."""
    return artifacts.select(F.col(key).alias("artifact_id"), content_hash(fields).alias("sha256")).groupBy(
        "artifact_id", "sha256"
    ).agg(F.count(F.lit(1)).alias("copies"))


def audit_diff(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Missing, extra, changed and intact artifacts of two manifests.

    Both sides go through one grouping instead of an outer join. Copies of one content
    are netted first, so repeated ids compare as whole sets of contents.
    """
    sides = recorded.select("artifact_id", "sha256", F.col("copies").alias("was"), F.lit(0).cast("bigint").alias("now")).unionByName(
        found.select("artifact_id", "sha256", F.lit(0).cast("bigint").alias("was"), F.col("copies").alias("now"))
    )
    contents = sides.groupBy("artifact_id", "sha256").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    artifacts = contents.groupBy("artifact_id").agg(
        F.sum("was").alias("recorded_copies"), F.sum("now").alias("found_copies"),
        F.count_if(F.col("was") != F.col("now")).alias("_differ"),
    )
    return artifacts.select(
        "artifact_id", "recorded_copies", "found_copies",
        F.when(F.col("found_copies") == 0, "missing").when(F.col("recorded_copies") == 0, "extra")
        .when(F.col("_differ") > 0, "changed").otherwise("intact").alias("audit"),
    )


def pseudonym(actor: Column, key: bytes) -> Column:
    """Keyed hash (HMAC-SHA256) of an actor; without the key no actor can be tried out."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(actor.cast("string"), "utf-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def private_log(log: DataFrame, key: bytes) -> DataFrame:
    """Request log with actors replaced by keyed hashes."""
    return log.select("id", "at", "system", "kind", pseudonym(F.col("actor"), key).alias("actor_hash"))


def private_counts(log: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Counts per group, shown only where at least ``k`` distinct actors are in it.

    Grouped by actor first: a hot group is counted by many tasks before its actors meet.
    """
    per_actor = log.groupBy(*keys, "actor").agg(F.count(F.lit(1)).alias("_r"))
    return per_actor.groupBy(*keys).agg(
        F.sum("_r").alias("requests"), F.count("actor").alias("actors")
    ).where(F.col("actors") >= k)


_KEYS = ["system", "day"]
_QUANTILES = {"p50_ms": 0.5, "p95_ms": 0.95}
#: Size of the stored sketches, and how far from a quantile's rank its bracket reaches: several
#: times their rank error of about 0.13 percent.
_SKETCH_K, _SKETCH_MARGIN = 4_096, 0.01


def _daily(log: DataFrame) -> DataFrame:
    return log.withColumn("day", F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd"))


def _counted() -> dict[str, Column]:
    return {"requests": F.count(F.lit(1)), "errors": F.count_if(F.col("kind") == "error")}


def _counters(measured: DataFrame) -> DataFrame:
    return measured.select(
        *_KEYS, "requests", "errors",
        (F.col("errors").cast("double") / F.col("requests").cast("double")).alias("error_rate"),
        *[F.col(name).cast("double").alias(name) for name in _QUANTILES],
    )


def workload_counters(log: DataFrame) -> DataFrame:
    """Requests, errors, error rate and exact latency quantiles per system and day; two scans."""
    return _counters(exact_quantiles(_daily(log), _KEYS, "latency_ms", _QUANTILES, _counted()))


def _by_day(rows: DataFrame, path: str) -> None:
    # Gathered by day into few files; a day too large for one task is split again.
    rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day"
    ).parquet(path)


def upsert_counters(counters: DataFrame, path: str) -> None:
    """Replace only the days present in ``counters``."""
    _by_day(counters, path)


def record_rows(fresh: DataFrame, log: DataFrame, path: str) -> None:
    """Take new rows of the log into the counters below ``path``.

    Counts and a quantile sketch per system and day are kept and merged with those of the new
    rows, which are read once. The merged sketches bracket the exact quantiles, for which the days
    of the new rows are read once more from ``log``, which holds them already; other
    days are neither read nor written. Rows without a time have no day and are left out;
    recording the same rows twice would count them twice.
    """
    spark = fresh.sparkSession
    parts, counted = f"{path}/sketches", f"{path}/counters"
    valid = F.when(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms"), F.col("latency_ms").cast("double"))
    new = _daily(fresh).groupBy(*_KEYS).agg(
        F.count(valid).alias("n"), F.min(valid).alias("_min"), F.max(valid).alias("_max"),
        F.kll_sketch_agg_double(valid, _SKETCH_K).alias("sketch"),
        *[aggregate.alias(name) for name, aggregate in _counted().items()],
    )
    staged = shared_path(spark, "new-counts")
    new.write.parquet(staged)
    new = spark.read.schema(new.schema).parquet(staged).where("day IS NOT NULL")
    days = [r["day"] for r in new.select("day").distinct().collect()]  # at most the days that there are
    stored = new
    if files_exist(spark, parts):
        stored = stored.unionByName(spark.read.schema(new.schema).parquet(parts).where(F.col("day").isin(days)))
    sums = {name: F.sum(name) for name in ("n", "requests", "errors")}
    merged = stored.groupBy(*_KEYS).agg(
        *[total.alias(name) for name, total in sums.items()], F.min("_min").alias("_min"), F.max("_max").alias("_max"),
        F.kll_merge_agg_double("sketch", _SKETCH_K).alias("sketch"),
    )
    # Written apart first: a partition is never read and replaced in one job.
    kept = shared_path(spark, "merged-counts")
    merged.write.parquet(kept)
    known = spark.read.schema(merged.schema).parquet(kept)
    _by_day(known, parts)
    edges = [F.lit(min(1.0, max(0.0, p + side))) for p in _QUANTILES.values() for side in (-_SKETCH_MARGIN, _SKETCH_MARGIN)]
    at = lambda edge: F.kll_sketch_get_quantile_double("sketch", edge)
    brackets = known.where("n > 0").select(*_KEYS, "n", "_min", "_max", F.array(*map(at, edges)).alias("_edges"))
    first, last = min(days, default=None), max(days, default=None)
    if first is None:
        return
    touched = log.where((F.col("at") >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz")) & (
        F.col("at") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    ))
    points = refined(_daily(touched).where(F.col("day").isin(days)), brackets, _KEYS, "latency_ms", _QUANTILES)
    points = points.drop("n").withColumnsRenamed({"system": "_system", "day": "_day"})
    same = F.col("system").eqNullSafe(F.col("_system")) & (F.col("day") == F.col("_day"))
    _by_day(_counters(known.join(points, same, "left")), counted)


def recorded_counters(spark: SparkSession, path: str) -> DataFrame:
    """All counters that ``record_rows`` has written."""
    schema = "system bigint, requests bigint, errors bigint, error_rate double, p50_ms double, p95_ms double, day string"
    return spark.read.schema(schema).parquet(f"{path}/counters").select(*_KEYS, "requests", "errors", "error_rate", *_QUANTILES)
