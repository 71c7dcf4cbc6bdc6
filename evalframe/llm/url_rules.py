"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule fits its host and every subdomain of it if the url's path starts with the rule's
path. Each url is expanded into the host suffixes and path prefixes that some rule could
name; expressions meet rules on the first 32 bits of their SHA-256, the full digest confirms
the hit, and the longest rule decides.

Nulls and odd input: a null url, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict. Repeated rows come back as often as they went in. An empty
table gives an empty result. Columns other than the id and the url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
#: Rules are a list in the driver. Up to this many (some 20 MB) are broadcast, more are shuffled.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: str, path: str, rules: Sequence[Rule]) -> Column:
    """All strings host suffix + path prefix whose shape some rule has."""
    labels = F.split(host, r"\.")
    shapes = sorted({(rule.host.count(".") + 1, len(rule.path)) for rule in rules})
    made = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= length),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, length)),
        )
        for n, length in shapes
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def _rule_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    table = df.sparkSession.createDataFrame(
        [(rule.host + rule.path, len(rule.host), len(rule.path), rule.verdict) for rule in rules],
        "rule string, host_length int, path_length int, rule_verdict string",
    )
    digest = F.sha2("rule", 256)
    table = table.select(
        digest.substr(1, PREFIX_HEX).alias("_prefix"), digest.alias("_digest"), "rule", "rule_verdict",
        # The longest rule wins; of one rule with two verdicts, block does.
        F.struct(
            (F.col("host_length") + F.col("path_length")).alias("length"), "host_length",
            (F.col("rule_verdict") == "block").alias("blocks"), "rule",
        ).alias("_rank"),
    )
    return F.broadcast(table) if len(rules) <= BROADCAST_RULES else table


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row.

    Equal rows are counted first, so the rows shuffle once by (id, url) and no url however
    frequent meets in one task; expansion, a broadcast rule join and the choice of the
    longest rule keep that partitioning.
    """
    distinct = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).groupBy("page_id", "url").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    split = distinct.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    expanded = split.withColumn("_expression", F.explode_outer(_expressions("host", "path", rules)))
    hashed = expanded.withColumn("_full", F.sha2("_expression", 256)).withColumn(
        "_short", F.col("_full").substr(1, PREFIX_HEX)
    )
    table = _rule_table(pages, rules)
    met = hashed.join(table, hashed["_short"] == table["_prefix"], "left")
    confirmed = F.col("_full") == F.col("_digest")
    best = F.max_by(F.struct("rule", "rule_verdict"), F.when(confirmed, F.col("_rank")))
    judged = met.groupBy("page_id", "url").agg(
        F.first("host").alias("host"), F.first("path").alias("path"), F.first("_copies").alias("_copies"),
        best.alias("_best"),
    )
    return judged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select(
        "page_id", "url", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"),
    )
