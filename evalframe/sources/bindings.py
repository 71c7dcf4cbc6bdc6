"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.times import iso_utc

ACTIVITY_ASOF = "2001-08-01T00:00:00"
EVENTS_ASOF = "2024-01-30T12:00:00"

_SUFFIX = {"en": ".py", "fr": ".ts", "de": ".md", "es": ".txt"}
_FOLDER = {"src3": "build", "src11": "node_modules/lib"}
_LANGUAGE = {"en": "Python", "fr": "TypeScript", "de": "Markdown"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(column, names: dict[str, str], otherwise):
    picked = F
    for key, value in names.items():
        picked = picked.when(column == key, value)
    return picked.otherwise(otherwise)


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per commit: an order placed by a customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("system"),
        F.col("o_orderkey").alias("commit_id"),
        F.col("o_orderdate").alias("commit_at"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


def _system_of_user():
    return F.pmod(F.col("user_id"), F.lit(20)).cast("bigint")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per poll of a system; error events are failed polls."""
    return table(spark, sf_dir, "events").select(
        _system_of_user().alias("system"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("id"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("value"),
    )


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request handled by a system."""
    return table(spark, sf_dir, "events").select(
        _system_of_user().alias("system"),
        F.col("user_id").alias("actor"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def source_files(spark: SparkSession, sf_dir: str, per_document: bool = False) -> DataFrame:
    """One row per file; two sources stand for excluded folders.

    The system is the source, or each document by itself.
    """
    source, lang = F.col("source"), F.col("lang")
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") if per_document else F.substring(source, 4, 10).cast("bigint")).alias("system"),
        F.concat(
            _named(source, _FOLDER, source), F.lit("/"), F.col("doc_id").cast("string"),
            _named(lang, _SUFFIX, F.lit("")),
        ).alias("path"),
        _named(lang, _LANGUAGE, F.lit(None).cast("string")).alias("language"),
        F.col("text"),
    )


def system_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status reports per actor, with unreachable polls and one unknown status."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("system"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("id"),
        F.when(kind == "error", "degraded").when(kind == "signup", "down")
        .when(kind.isin("view", "click"), "operational").alias("status"),
        ((kind != "purchase") | (F.col("value") > 30)).alias("reachable"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry envelopes carrying every kind of contract defect."""
    k, stamp = F.col("k"), F.col("stamp")
    value, kind = F.col("value"), F.col("event_type")
    null_text = F.lit(None).cast("string")
    null_count = F.lit(None).cast("bigint")
    # Read once per row into columns; most fields below use them.
    parsed = table(spark, sf_dir, "events").withColumns(
        {"k": F.get_json_object("props", "$.k").cast("int"), "stamp": iso_utc(F.col("ts"))}
    )
    return parsed.select(
        F.col("event_id").alias("id"),
        F.when(k == 13, null_text).otherwise(F.concat(F.lit("sys-"), _system_of_user().cast("string"))).alias("system"),
        F.when(k < 10, "demo").when(k < 50, null_text).when(k < 75, "live").otherwise("showcase").alias("mode"),
        F.when(kind == "error", "degraded").when(kind == "signup", "offline")
        .when(kind == "purchase", "down").otherwise("operational").alias("status"),
        F.when(k == 70, "garbage").when(k == 71, null_text).otherwise(stamp).alias("last_commit_at"),
        F.when(k == 80, "soon").otherwise(stamp).alias("last_deployed_at"),
        F.floor(value * 1_000).cast("bigint").alias("commits_30d"),
        F.floor(value * 1_000 * k).cast("bigint").alias("commits_total"),
        F.when(kind == "view", -k.cast("bigint")).otherwise(k.cast("bigint")).alias("repo_stars"),
        F.when(k > 90, null_count).otherwise(F.floor(value * 100_000).cast("bigint")).alias("lines_of_code"),
        F.when(k == 42, 2).otherwise(1).alias("schema_version"),
        F.when((k >= 60) & (k < 65), F.left(stamp, F.lit(19))).when(k == 66, "yesterdayZ")
        .otherwise(stamp).alias("generated_at"),
    )


def timestamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as outside systems send them: text, sometimes missing or broken."""
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("feed"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "garbage")
        .when((F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") != "1-URGENT"), iso_utc(F.col("o_orderdate")))
        .alias("at_text"),
        F.lit("2001-01-01T00:00:00").cast("timestamp_ntz").alias("asof"),
    )
    events = table(spark, sf_dir, "events").select(
        F.lit("events").alias("feed"),
        iso_utc(F.col("ts")).alias("at_text"),
        F.lit(EVENTS_ASOF).cast("timestamp_ntz").alias("asof"),
    )
    return orders.unionByName(events)


def response_pages(spark: SparkSession, sf_dir: str, asof, window_days: int) -> DataFrame:
    """Upstream pages as harvested, one row per system and kind, from the commit log."""
    recent = F.col("commit_at") >= asof - F.expr(f"INTERVAL {window_days} DAYS")
    totals = commit_log(spark, sf_dir).groupBy("system").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(recent).alias("recent"),
        F.max("commit_at").alias("newest"),
        F.count_if(F.col("priority") == "1-URGENT").alias("urgent"),
    )
    base = F.concat(F.lit("<https://host/systems/"), F.col("system").cast("string"), F.lit("/commits?per_page=1&page="))
    commit = F.concat(F.lit('[{"commit":{"author":{"date":"'), iso_utc(F.col("newest")), F.lit('"}}}]'))

    def link(count):
        last = F.concat(base, F.lit('2>; rel="next", '), base, count.cast("string"), F.lit('>; rel="last"'))
        return F.when(count > 1, last)

    language = (
        F.when(F.col("urgent") == 0, F.lit("null")).when(F.col("urgent") == 1, F.lit('""'))
        .when(F.col("urgent") == 2, F.lit('"Go"')).otherwise(F.lit('"Python"'))
    )
    stars = F.when(F.col("urgent") == 0, F.lit("null")).otherwise(F.col("urgent").cast("string"))
    repo = F.concat(F.lit('{"stargazers_count":'), stars, F.lit(',"language":'), language, F.lit("}"))
    nothing = F.lit(None).cast("string")
    page = F.explode(F.array(
        F.struct(F.lit("repo").alias("kind"), nothing.alias("link"),
                 F.when(F.col("total") == 13, F.lit('{"stargazers_count":')).otherwise(repo).alias("body")),
        F.struct(F.lit("latest").alias("kind"), link(F.col("total")).alias("link"), commit.alias("body")),
        F.struct(F.lit("recent").alias("kind"), link(F.col("recent")).alias("link"),
                 F.when(F.col("recent") > 0, commit).otherwise(F.lit("[]")).alias("body")),
    ))
    return totals.select("system", page.alias("page")).select("system", "page.*")


def harvest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream pages as they were fetched: each event is a harvest, of three calls in turn.

    Error events got a broken repository page; after a signup the last call timed out.
    """
    k = F.col("k")
    shift = lambda seconds: F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")
    language = F.when(k < 10, F.lit("null")).when(k < 20, F.lit('""')).when(k < 60, F.lit('"Go"')).otherwise(F.lit('"Python"'))
    stars = F.floor(F.col("value") * 1_000).cast("string")
    repo = F.concat(F.lit('{"stargazers_count":'), stars, F.lit(',"language":'), language, F.lit("}"))
    commit = F.concat(F.lit('[{"commit":{"author":{"date":"'), iso_utc(F.col("ts")), F.lit('"}}}]'))
    last = lambda n: F.concat(F.lit("<https://host/commits?per_page=1&page="), n.cast("string"), F.lit('>; rel="last"'))
    nothing = F.lit(None).cast("string")

    def page(call: int, kind: str, link: Column, body: Column) -> Column:
        return F.struct(
            (F.col("event_id") * 3 + call).alias("id"), F.lit(kind).alias("kind"), link.alias("link"), body.alias("body"),
            shift(call * 2).alias("fetched_at"),
        )

    calls = F.array(
        page(0, "repo", nothing, F.when(F.col("event_type") == "error", F.lit('{"stargazers_count":')).otherwise(repo)),
        page(1, "latest", last(F.col("event_id") + 2), commit),
        F.when(F.col("event_type") != "signup", page(2, "recent", F.when(k > 1, last(k)), F.when(k > 0, commit).otherwise(F.lit("[]")))),
    )
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(_system_of_user().alias("system"), F.explode(calls).alias("p")).where("p IS NOT NULL").select("system", "p.*")


def turn_id() -> Column:
    """One number for a conversation and a turn; turns stay below 2**32."""
    return F.shiftleft(F.col("conv_id").cast("bigint"), 32) + F.col("turn")


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it, if any."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected")
    )
    # Joined on (conversation, turn), so one long conversation spreads over all tasks.
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        F.lit("chat").alias("dataset_id"),
        turn_id().alias("case_id"),
        F.when(F.col("turn") <= 1, "opening").otherwise("follow_up").alias("slice"),
        "input",
        "expected",
    )


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in [0, 1] on a grid of 1/10000, with several trials per case."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("run"),
        F.col("l_returnflag").alias("slice"),
        F.col("l_partkey").alias("case_id"),
        F.col("l_orderkey").alias("trial"),
        (1 - F.col("l_discount")).cast("decimal(6,4)").alias("score"),
        F.when((F.col("l_tax") == 0) & (F.col("l_linestatus") == "F"), "timeout").alias("error"),
        F.col("l_shipdate").alias("at"),
    )
