"""Cache classes of polls, where each fetch depends on the one before.

A fetch is the first good poll a lifetime or more after the last fetch, so what happens in a
stretch of time depends on its past only through the last fetch before it. Stretches are
composed as maps from the last fetch before to the last fetch within: a map is a few sorted
arrays (good polls that may be the first fetch, and the last fetch that follows from each).
Maps compose to a map, in any grouping: those of many stretches become one of a period, the few
of a system's periods tell the last fetch before each, and that is handed down to the stretches.
A system's polls are never walked from end to end in one task, and its rows are joined, not
windowed, so AQE can split a hot system's.

Only a first fetch within one lifetime of a stretch's start depends on the past: a later one is
the first good poll there is. Neighbouring entries with one outcome are merged, so maps shrink
as they go up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions import fixed_values as fixed
from evalframe.functions.times import micros
from evalframe.session import shared_path

#: Lifetimes of the lowest stretch: one array holds the good polls of a system in it.
SPAN = 8
#: Stretches of a period, as a power of two. A system has one small map per period in one
#: array: 52 a year with 300 seconds.
FAN_BITS = 8
_MAP = "struct<entries:array<bigint>,exits:array<bigint>,rest:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _first_from(sorted_values: Column, least: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Index of the first element not below ``least``; the array's size if there is none."""
    begun = F.struct(F.lit(0).alias("low"), F.size(sorted_values).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = of(F.get(sorted_values, middle)) < least
        # A search that has ended stays where it is: there is no element beyond.
        return F.when(s["low"] >= s["high"], s).when(
            below, F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        ).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(sorted_values))))
    return F.aggregate(halvings, begun, halve, lambda s: s["low"])


def _merged(entries: Column, exits: Column, rest: Column) -> Column:
    """A map whose neighbouring entries have different exits; the latest of equals stands."""
    last = lambda i: ~F.get(exits, i).eqNullSafe(F.get(exits, i + 1))
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(e.alias("e"), F.get(exits, i).alias("x"), last(i).alias("k"))), lambda x: x["k"])
    return _let(kept, lambda kept: F.struct(
        F.transform(kept, lambda x: x["e"]).alias("entries"), F.transform(kept, lambda x: x["x"]).alias("exits"),
        rest.alias("rest"),
    )).cast(_MAP)


def _after(m: Column, last: Column, ttl_us: int) -> Column:
    """The last fetch after a stretch with map ``m``, given the one before it, if any."""
    due = F.coalesce(last + ttl_us, F.lit(-(2**63)))
    return _let(_first_from(m["entries"], due), lambda i: F.coalesce(F.get(m["exits"], i), m["rest"], last))


def _fetches(polls: Column, last: Column, ttl_us: int) -> Column:
    """The polls of one stretch that fetch, in order: at most one more than ``SPAN``."""
    newest = F.try_element_at(polls, F.lit(-1))["us"]

    def hop(state: Column, _: Column) -> Column:
        at = _first_from(polls, state["due"], lambda p: p["us"])
        fetched = _let(F.get(polls, at), lambda p: F.struct(
            (p["us"] + ttl_us).alias("due"), F.concat(state["found"], F.array(p)).alias("found")
        ))
        return F.when(newest >= state["due"], fetched).otherwise(state)

    none = F.array().cast("array<struct<us:bigint,id:bigint>>")
    begun = F.struct(F.coalesce(last + ttl_us, F.lit(-(2**63))).alias("due"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SPAN)), begun, hop, lambda s: s["found"])


def _stretch_map(polls: Column, start: Column, ttl_us: int) -> Column:
    """The map of one lowest stretch from its sorted good polls."""
    last_of = lambda fetched: F.try_element_at(fetched, F.lit(-1))["us"]
    entries = F.array_distinct(F.transform(F.filter(polls, lambda p: p["us"] < start + ttl_us), lambda p: p["us"]))
    exits = lambda found: F.transform(found, lambda e: last_of(_fetches(polls, e - ttl_us, ttl_us)))
    rest = last_of(_fetches(polls, start, ttl_us))
    return _let(entries, lambda found: _let(exits(found), lambda x: _merged(found, x, rest)))


def _joined_map(children: Column, first_node: Column, ttl_us: int) -> Column:
    """The map of a node from the maps of its children, sorted by time.

    Only a child at the very start of the node has entries that depend on the past.
    """
    head = F.get(children, F.lit(0))
    opens = head["node"] == first_node
    begun = F.when(opens, head["map"]).otherwise(
        F.struct(F.array().alias("entries"), F.array().alias("exits"), F.lit(None).alias("rest")).cast(_MAP)
    )

    def join(m: Column, child: Column) -> Column:
        return F.struct(
            m["entries"].alias("entries"),
            F.transform(m["exits"], lambda last: _after(child["map"], last, ttl_us)).alias("exits"),
            _after(child["map"], m["rest"], ttl_us).alias("rest"),
        ).cast(_MAP)

    later = F.filter(children, lambda c, i: (i > 0) | ~opens)
    return F.aggregate(later, begun, join, lambda m: _merged(m["entries"], m["exits"], m["rest"]))


def _before(children: Column, last: Column, ttl_us: int) -> Column:
    """Each child with the last fetch before it."""
    none = F.array().cast("array<struct<node:bigint,last:bigint>>")
    begun = F.struct(last.alias("last"), none.alias("told"))

    def hand(s: Column, child: Column) -> Column:
        told = F.concat(s["told"], F.array(F.struct(child["node"].alias("node"), s["last"].alias("last"))))
        return F.struct(_after(child["map"], s["last"], ttl_us).alias("last"), told.alias("told"))

    return F.aggregate(children, begun, hand, lambda s: s["told"])


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetches(observed: DataFrame, ttl_seconds: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """``system, node, last, fetches`` for every stretch with a poll.

    ``last`` is the last fetch before the stretch and ``fetches`` are the polls in it that fetch.
    """
    ttl_us = ttl_seconds * 1_000_000
    width = ttl_us * SPAN
    rows = observed.select("system", "ok", "id", micros(F.col("at")).alias("us"))
    good = F.when(F.col("ok"), F.struct("us", F.col("id").cast("bigint").alias("id")))
    stretches = rows.groupBy("system", stretch_of(F.col("us"), ttl_seconds).alias("node")).agg(
        F.array_sort(F.collect_list(good)).alias("polls")  # of one system, for SPAN lifetimes
    )
    lowest = _kept(stretches.withColumn("map", _stretch_map(F.col("polls"), F.col("node") * width, ttl_us)), "stretches")
    children = F.array_sort(F.collect_list(F.struct("node", "map")))  # 2**FAN_BITS at most
    periods = lowest.groupBy("system", F.shiftright("node", FAN_BITS).alias("period")).agg(children.alias("children"))
    mapped = periods.select("system", F.struct(
        F.col("period").alias("node"), _joined_map(F.col("children"), F.shiftleft("period", FAN_BITS), ttl_us).alias("map")
    ).alias("_p"))
    whole = mapped.groupBy("system").agg(F.array_sort(F.collect_list("_p")).alias("periods"))
    begun = whole.select("system", F.explode(_before(F.col("periods"), F.lit(None).cast("bigint"), ttl_us)).alias("x")).select(
        "system", F.col("x.node").alias("period"), "x.last"
    )
    told = periods.join(begun, ["system", "period"]).select(
        "system", F.explode(_before(F.col("children"), F.col("last"), ttl_us)).alias("x")
    ).select("system", "x.*")
    return lowest.select("system", "node", "polls").join(told, ["system", "node"]).select(
        "system", "node", "last", _fetches(F.col("polls"), F.col("last"), ttl_us).alias("fetches")
    )


def stretch_of(us: Column, ttl_seconds: int) -> Column:
    """Number of the lowest stretch of time that ``us`` is in."""
    width = ttl_seconds * 1_000_000 * SPAN
    return ((us - F.pmod(us, F.lit(width))) / width).cast("bigint")


def freshness(observed: DataFrame, ttl_seconds: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Cache class of each observation.

    A poll within the lifetime of the last fetch is a hit: it fetches nothing, renews
    nothing, and serves data as old as that fetch. A good poll after it fetches; a failed one
    serves the stale fetch and leaves its time.
    """
    ttl_us = ttl_seconds * 1_000_000
    us = micros(F.col("at"))
    rows = observed.select("system", "at", "id").withColumns({"_us": us, "node": stretch_of(us, ttl_seconds)})
    here = F.struct(F.col("_us").alias("us"), F.col("id").cast("bigint").alias("id"))
    so_far = F.filter("fetches", lambda f: f <= here)  # SPAN + 1 at most
    joined = rows.join(fetches(observed, ttl_seconds), ["system", "node"]).withColumn("_newest", F.try_element_at(so_far, F.lit(-1)))
    age = F.col("_us") - F.coalesce("_newest.us", "last")
    return joined.withColumn("_age", age).select(
        "system", "at", "id",
        F.when(F.col("_newest") == here, "refetch").when(F.col("_age").isNull(), "empty")
        .when(F.col("_age") < ttl_us, "hit").otherwise("stale").alias("cache_class"),
        F.floor(F.col("_age") / F.lit(1_000_000)).cast("bigint").alias("data_age_s"),
    )


def freshness_report(observed: DataFrame, ttl_seconds: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Polls and the age of the oldest data served, per system and class."""
    return freshness(observed, ttl_seconds).groupBy("system", "cache_class").agg(
        F.count(F.lit(1)).alias("n"), F.max("data_age_s").alias("max_data_age_s")
    )
