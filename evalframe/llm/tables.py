"""Reading the given tables, and writing intermediates to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalframe.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write once below ``spark.checkpoint.dir`` and read back.

    Readers of the result start from files every executor can reach, so a lost executor
    repeats no work above the table.
    """
    return written_at(df, purpose)[0]


def written_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The same, with the folder, for tables that are removed when their readers are done."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Remove folders that no later read needs."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
