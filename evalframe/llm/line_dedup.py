"""Line dedup by distinct-site spread.

A line's hash gathers a HyperLogLog sketch of the sites it is found on; sketches merge in the
map tasks and again in the reduce tasks, so a line on every page of the corpus ships one
sketch per task. Only lines with two different sites get a sketch at all. Lines whose
estimate is near the threshold get an exact distinct count. Lines on ``min_sites`` sites or
more are boilerplate and go everywhere but at their first place (smallest document id, then
line number), so no text is lost from the corpus altogether.

Lines compare trimmed and in lower case, as 64-bit hashes. Nulls and odd input: a null text
has no lines and stays null, a null site is one site of its own, blank lines are never
boilerplate and always stay. Equal rows lose the same lines. An empty table gives an empty
result. All columns of the input come back; ``n_removed_lines`` is added, replacing a column
of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.quality import SPACES
from evalframe.llm.tables import written

MIN_SITES = 10
LG_K = 12
#: Four standard errors of a sketch with 2**LG_K registers, 1.04 / 64 each.
MARGIN = 0.065


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line with a character: row key, place, site hash and line hash."""
    rows = docs.select(
        F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc"),
        F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("at", "_line"),
    )
    return rows.where(_normal(F.col("_line")) != "").select("row", "doc", "site", "at", F.xxhash64(_normal(F.col("_line"))).alias("line"))


def boilerplate_places(
    docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """``row, drop``: for each row key the numbers of the lines to remove."""
    lines = _lines(docs, doc_id, text, site)
    several = lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("line")
    # A small part of all lines; sketches, exact counts and places all start from it.
    shared = written(lines.join(several, "line", "left_semi"), "shared-lines")
    sketched = shared.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    spread = written(sketched.where(F.col("sites") >= low), "line-spread")
    near = spread.where(F.col("sites") <= high).select("line")
    exact = (
        shared.join(near, "line", "left_semi").select("line", "site").distinct()
        .groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("line")
    )
    wide = spread.where(F.col("sites") > high).select("line").unionAll(exact)
    found = shared.join(wide, "line", "left_semi")
    first = found.groupBy("line").agg(F.min(F.struct("doc", "at")).alias("_first"))
    removed = found.join(first, "line").where(~F.struct("doc", "at").eqNullSafe(F.col("_first")))
    return removed.groupBy("row").agg(F.collect_set("at").alias("drop"))


def drop_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """The documents without their boilerplate lines, and how many each lost."""
    places = boilerplate_places(docs, min_sites, doc_id, text, site).withColumnsRenamed({"row": "_row", "drop": "_drop"})
    lines = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    keyed = docs.withColumn("_key", F.xxhash64(doc_id, text))
    joined = keyed.join(places, keyed["_key"] == places["_row"], "left")
    return joined.withColumns({
        text: F.when(F.col("_drop").isNull(), F.col(text)).otherwise(left),
        "n_removed_lines": F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("bigint"),
    }).drop("_key", "_row", "_drop")
