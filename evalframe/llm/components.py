"""Connected components of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.tables import removed, written_at


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of a link ``a, b``; the component is its smallest id.

    Large-star and small-star steps in turn: each node hands its neighbours to the smallest
    of them, until all edges point at their component's smallest id. Minima combine in the
    map tasks, so a node with very many links is no single task's work; the table of each
    step is written, which cuts the lineage, and removed once the next one is.
    """
    edges, at = written_at(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while True:
        # Large star: neighbours above a node go to the least of its neighbourhood.
        near = _both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_at = written_at(large.distinct(), "large-star")
        # Small star: neighbours below a node, and the node, go to the least of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b")
        after, after_at = written_at(small.distinct(), "small-star")
        removed(links.sparkSession, at, large_at)
        # Settled once every node has one edge and no edge ends at a node with an edge of its own.
        loose = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        many = 0 if loose else after.groupBy("a").count().where("count > 1").limit(1).count()
        edges, at = after, after_at
        if not loose and not many:
            break
    tops = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        tops.select("id", F.col("id").alias("component"))
    )
