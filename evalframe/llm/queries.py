"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import (
    chat_format, decontaminate, filter_audit, html_text, lexical, line_dedup, mixing, near_dedup, quality, sharding,
    suffix_dedup, token_counts, url_rules,
)
from evalframe.llm.tables import table

RULES = (
    url_rules.Rule("net", "/", "block"), url_rules.Rule("example.net", "/en/", "allow"),
    url_rules.Rule("example.com", "/de/", "block"), url_rules.Rule("org", "/fr/", "allow"),
)
#: A conversation made of control strings, formatted with the others.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sources share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_removed_lines")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to sources weighing the square root of their characters, shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), RULES).drop("url")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the examples of every conversation hold, read back from them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(probe)))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_chars", "base_failed", "kept"
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to those with smaller ids, and the digest of the rest."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    lost = F.aggregate(
        F.zip_with("span_stops", "span_starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda total, n: total + n
    )
    return cut.select(
        "doc_id", "n_bytes", lost.alias("n_removed"), F.size("span_starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in a uniform shuffle."""
    sharded = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select(
        "doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
        "law", "shard", "slot", "grown_shard",
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REGISTERED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_line_dedup, op2_mixing, op3_url_filters, op4_token_counts, op5_decontamination, op6_chat_format,
    op7_minhash_near_dedup, op8_quality_rules, op9_html_text, op10_suffix_dedup, op11_sharding, op12_lexical_search,
    op13_filter_audit,
)
