"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mix over its share of the
characters. Each document draws its own count: a hash of its id and the seed gives a number
in [0, 1), and the count is the inverse of the Poisson distribution with that mean. Documents
are exploded by their count and shuffled globally by a hash of (id, copy). No draw depends on
another row or on partitioning, so a repeated task gives the same copies.

Nulls and odd input: a null source is a source of its own; a null text has no characters;
a source without characters, or without a weight, has rate 0 and leaves the mix; rows with
equal ids draw equal counts. An empty table gives an empty result. All columns of the input
come back; ``copy`` (from 1) is added, replacing a column of that name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.tables import written

SEED = "mix-1"
#: Without given weights a source weighs its characters to this power.
TEMPERATURE = 0.5


def uniform(key: Column, seed: str) -> Column:
    """52 bits of the MD5 of seed and key, as a number in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / float(2**52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... to where less than one draw in 2**53 is beyond."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(rate) - F.ln(k)
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"]))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """``source, rate``: mean copies per document; the mix has as many characters as the input."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("double").alias("chars")
    ).where("chars > 0")
    if weights is None:
        weight = F.pow("chars", F.lit(TEMPERATURE))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("source")], F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    # One row; the shares follow by a join of one row per source with it.
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    return sizes.join(F.broadcast(total), F.lit(True)).select(
        "source", (F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")).alias("rate")
    )


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, seed: str = SEED, doc_id: str = "doc_id",
    source: str = "source", text: str = "text",
) -> DataFrame:
    """The mix in its shuffled order.

    The rate table has one row per source and is written first, so Spark knows its size and
    broadcasts it where that is small; else the join shuffles and AQE splits hot sources.
    """
    table = rates(docs, weights, source, text).select(F.col("source").alias("_source"), poisson_cdf(F.col("rate")).alias("_cdf"))
    known = written(table.where(F.col("_cdf").isNotNull()), "mix-rates")
    drawn = docs.join(known, docs[source].eqNullSafe(known["_source"])).withColumn("_u", uniform(F.col(doc_id), seed))
    count = F.size(F.filter("_cdf", lambda p: p <= F.col("_u")))
    copies = drawn.withColumn("_n", count).drop("_source", "_cdf", "_u", "copy").where("_n > 0")
    spread = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    order = spread.withColumn("_order", F.xxhash64(F.lit(seed), F.col(doc_id), "copy"))
    return order.repartition("_order").sortWithinPartitions("_order").drop("_order").withColumn("copy", F.col("copy").cast("bigint"))
