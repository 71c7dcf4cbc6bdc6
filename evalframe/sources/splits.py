"""Records of large CSV and JSON-array files, read by many tasks.

A file is read in pieces, CSV by lines and arrays by closing braces, so it splits like any text.
Whether a piece begins inside quotes, or how deep in braces, depends on all before it; each split
sums up what it does to that state, the few sums are put in order, and every piece then knows
where it stands. Records of one piece need nothing more; only those of several are put together.

CSV files double their quotes and quote a field as a whole (RFC 4180). In an array, records are
objects; other elements come as broken records. A record of more than ``MOST_PIECES`` pieces,
as a quote that is never closed makes of all the rest of a file, comes as its pieces, each of
which is then a broken record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.session import shared_path

MOST_PIECES = 100_000
_PLACE = ["file", "block"]
_EARLIER = (Window.unboundedPreceding, -1)


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Pieces with their file and split; ``at`` is their order within a split."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _before(total: str) -> Column:
    """What the splits of a file before this one sum up to."""
    return F.coalesce(F.sum(total).over(Window.partitionBy("file").orderBy("block").rowsBetween(*_EARLIER)), F.lit(0))


def _within(value: str) -> Column:
    """What the pieces of a split before this one sum up to. A split is one task's input."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*_PLACE).orderBy("at").rowsBetween(*_EARLIER)), F.lit(0))


def _joined(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Join a row per split to the split's pieces, which lie by split already."""
    return rows.join(places.hint("shuffle_hash"), _PLACE)


def _records(told: DataFrame, glue: str, end: str) -> DataFrame:
    """``file, record`` out of pieces with ``starts`` and ``ends``: whether a record does there."""
    path = shared_path(told.sparkSession, "pieces")
    told.write.parquet(path)
    told = told.sparkSession.read.schema(told.schema).parquet(path)
    whole = told.where("starts AND ends").select("file", F.concat("value", F.lit(end)).alias("record"))
    parts = told.where("NOT (starts AND ends)")
    # A record is known by its first piece, in this split or in the last one before that has one.
    upto = Window.partitionBy(*_PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.last(F.when(F.col("starts"), F.struct("block", "at")), ignorenulls=True)
    begun = parts.withColumn("_own", local.over(upto))
    newest = begun.groupBy(*_PLACE).agg(F.max("_own").alias("_newest"))
    carry = F.last("_newest", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(*_EARLIER))
    first = F.coalesce("_own", "_carry")
    # What comes before any record of a file is a broken one of its own.
    keyed = _joined(begun, newest.select(*_PLACE, carry.alias("_carry"))).withColumns({
        "_block": F.coalesce(first["block"], F.lit(-1)), "_at": F.coalesce(first["at"], F.lit(-1)),
    })
    record = ["file", "_block", "_at"]
    sizes = keyed.groupBy(*record).agg(F.count(F.lit(1)).alias("_n"))
    sized = keyed.select(*record, "block", "at", "value").join(sizes, record)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    several = sized.where(F.col("_n") <= MOST_PIECES).groupBy(*record).agg(lines.alias("lines"))
    return whole.unionByName(several.select("file", F.concat(F.array_join("lines", glue), F.lit(end)).alias("record"))).unionByName(
        sized.where(F.col("_n") > MOST_PIECES).select("file", F.concat("value", F.lit(end)).alias("record"))
    )


def csv_records(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``file, record`` of CSV files whose quoted fields may hold line breaks."""
    lines = _pieces(spark, path, "\n").withColumn("quotes", _count(F.col("value"), '"'))
    splits = lines.groupBy(*_PLACE).agg(F.sum("quotes").alias("quotes"))
    placed = _joined(lines, splits.select(*_PLACE, _before("quotes").alias("_upto")))
    state = placed.withColumn("_quotes", F.col("_upto") + _within("quotes")).withColumn(
        "_nr", F.row_number().over(Window.partitionBy(*_PLACE).orderBy("at"))
    )
    told = state.select(
        *_PLACE, "at", "value", (F.col("_quotes") % 2 == 0).alias("starts"),
        ((F.col("_quotes") + F.col("quotes")) % 2 == 0).alias("ends"), ((F.col("block") == 0) & (F.col("_nr") == 1)).alias("_first"),
    )
    if header:
        told = told.where(~F.col("_first"))
    records = _records(told.drop("_first"), "\n", "")
    return records.select("file", F.regexp_replace("record", "\\r$", "").alias("record")).where("record <> ''")


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record`` of files that each hold one JSON array of objects."""
    pieces = _pieces(spark, path, "}").withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", ""))
    outside = F.regexp_replace("_plain", '"[^"]*("|$)', "")
    inside = F.regexp_replace(F.regexp_replace("_plain", '^[^"]*("|$)', ""), '"[^"]*("|$)', "")
    counted = pieces.select(
        *_PLACE, "at", "value", _count(F.col("_plain"), '"').alias("quotes"),
        _count(outside, "{").alias("_outer"), _count(inside, "{").alias("_inner"),
    ).withColumn("_quotes", _within("quotes"))

    def rise(quoted: Column) -> Column:
        """Braces opened in a piece that begins in quotes or not, less the one that ends it outside of quotes."""
        ends_inside = (quoted.cast("int") + F.col("quotes")) % 2 == 1
        return F.when(quoted, F.col("_inner")).otherwise(F.col("_outer")) - F.when(ends_inside, 0).otherwise(1)

    odd = F.col("_quotes") % 2 == 1
    both = counted.withColumns({"_rise0": rise(odd), "_rise1": rise(~odd)})
    splits = both.groupBy(*_PLACE).agg(F.sum("quotes").alias("quotes"), F.sum("_rise0").alias("_rise0"), F.sum("_rise1").alias("_rise1"))
    begun = splits.withColumn("_odd", _before("quotes") % 2 == 1)
    begun = begun.withColumn("_rise", F.when(F.col("_odd"), F.col("_rise1")).otherwise(F.col("_rise0")))
    placed = _joined(both, begun.select(*_PLACE, "_odd", _before("_rise").alias("_depth")))
    state = placed.withColumn("_rise", F.when(F.col("_odd"), F.col("_rise1")).otherwise(F.col("_rise0")))
    state = state.withColumn("_deep", F.col("_depth") + _within("_rise"))
    starts = F.col("_deep") <= 0
    # Between records there are only blanks, commas and the array's brackets.
    text = F.when(starts, F.regexp_replace("value", r"^[\s,\[\]]+", "")).otherwise(F.col("value"))
    told = state.select(
        *_PLACE, "at", text.alias("value"), starts.alias("starts"), (F.col("_deep") + F.col("_rise") <= 0).alias("ends"),
    ).where("NOT starts OR value <> ''")
    return _records(told, "}", "}")
