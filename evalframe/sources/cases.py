"""Evaluation cases from JSON and CSV files, with broken rows set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.sources.splits import csv_records, json_array_records

CASE_SCHEMA = "dataset_id string, case_id bigint, slice string, input string, expected string"
#: Cases with what else is known of them.
FULL_SCHEMA = f"{CASE_SCHEMA}, meta map<string,string>"
_BROKEN = "_broken"


def _reader(spark: SparkSession):
    return (
        spark.read.schema(f"{CASE_SCHEMA}, {_BROKEN} string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
    )


def load_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Cases from JSON lines, or from files that each hold one JSON array.

    Lines split over tasks. An array file is one record to Spark's reader; large ones are
    read by ``load_large_array``.
    """
    return _reader(spark).option("multiLine", array).json(path)


def load_csv(spark: SparkSession, path: str, header: bool = True, multi_line: bool = False) -> DataFrame:
    """Cases from CSV. With ``multi_line`` quoted fields may hold newlines, and a file is one task;
    ``load_large_csv`` reads such files with many tasks."""
    return (
        _reader(spark).option("header", header).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def load_large_array(spark: SparkSession, path: str) -> DataFrame:
    """Cases with ``meta`` from files that each hold one JSON array, split over tasks."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    records = json_array_records(spark, path)
    return records.select(F.from_json("record", f"{FULL_SCHEMA}, {_BROKEN} string", options).alias("c")).select("c.*")


def load_large_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Cases with ``meta`` (a JSON object in the last field) from quoted CSV, split over tasks."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "quote": '"', "escape": '"'}
    records = csv_records(spark, path, header)
    parsed = records.select(F.from_csv("record", f"{CASE_SCHEMA}, meta string, {_BROKEN} string", options).alias("c")).select("c.*")
    return parsed.withColumn("meta", F.from_json("meta", "map<string,string>"))


def _is_broken(loaded: DataFrame) -> Column:
    """Whether a row is set aside, judged on all of its fields.

    The readers parse only the columns a query uses and would miss a fault in the others,
    so the test, which always holds, makes every query use all of them.
    """
    # Maps have no hash; their text has.
    fields = [F.to_json(name) if kind.startswith("map") else F.col(name) for name, kind in loaded.dtypes if name != _BROKEN]
    return F.col(_BROKEN).isNotNull() & (F.hash(*fields) >= -(2**31))


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.where(~_is_broken(loaded)).drop(_BROKEN)


def quarantine(loaded: DataFrame) -> DataFrame:
    return loaded.where(_is_broken(loaded)).select(F.col(_BROKEN).alias("raw"))


def load_report(loaded: DataFrame, fmt: str) -> DataFrame:
    """Accepted and set-aside rows together; a set-aside row keeps only its raw text,
    without the line break that ends the record."""
    judged = loaded.withColumn("quarantined", _is_broken(loaded))
    kept = [F.when(~F.col("quarantined"), F.col(name)).alias(name) for name in loaded.columns if name != _BROKEN]
    return judged.select(F.lit(fmt).alias("format"), "quarantined", *kept, F.regexp_replace(F.col(_BROKEN), "\\r?\\n$", "").alias("raw"))


def raw_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines parsed to cases beside their raw text, for field checks."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.from_json("value", CASE_SCHEMA).alias("c"), F.col("value").alias("raw")
    ).select("c.*", "raw")
