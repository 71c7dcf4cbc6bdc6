"""The corpus pipeline: five stages from documents to a training mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns of
``documents``.

Nulls and odd input: a null or empty text has no words and goes with the first stage. A null id
is an id like others, a null source a source of its own, a null language or count is kept or
renewed. Rows with equal ids and texts are one document to the near-dedup stage: all of them
stay or go, and they draw equal counts in the mix. Texts are worked on whole, however long.
Columns beyond those of ``documents`` are left out. No documents give no result; without
benchmark items nothing is taken for contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from evalframe.llm.tables import table, written
from evalframe.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, then documents that fail or lost too much text."""
    return quality.keep_good(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go everywhere but at their first place; every document stays."""
    cut = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return near_dedup.keep_first(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's weight, shuffled, with the number of the copy."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules), ("line dedup", shared_lines), ("near dedup", near_copies),
    ("decontamination", benchmark_leaks), ("mixing", source_mix),
]

#: The stages on near copies and windows can't be said in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
