"""Report arithmetic against its published examples."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evalframe.functions import formatting as shown
from evalframe.functions.quantiles import exact_quantiles
from evalframe.functions.times import instant, parse_iso
from evalframe.operators import reporting


def test_utilisation_examples(spark):
    cases = [(50.0, 100.0, 50.0), (150.0, 100.0, 100.0), (-5.0, 100.0, 0.0), (50.0, None, 0.0), (50.0, 0.0, 0.0),
             (50.0, -1.0, 0.0), (50.0, float("nan"), 0.0), (None, 10.0, 0.0)]
    df = spark.createDataFrame(cases, "used double, limit double, want double")
    assert df.where(~shown.utilisation(F.col("used"), F.col("limit")).eqNullSafe(F.col("want"))).collect() == []


def test_duration_examples(spark):
    cases = [(0.4, "<1ms"), (420.0, "420ms"), (3450.0, "3.45s"), (120_000.0, "2m"), (None, "—"), (float("nan"), "—"),
             (-5.0, "—"), (999.6, "1000ms"), (59_999.0, "60.00s"), (60_000.0, "1m"), (1.0, "1ms"), (0.0, "<1ms"),
             (1_000.0, "1.00s"), (89_999.0, "1m"), (90_000.0, "2m"), (2.5, "3ms")]
    df = spark.createDataFrame(cases, "ms double, want string")
    assert df.where(~shown.duration_text(F.col("ms")).eqNullSafe(F.col("want"))).collect() == []


def test_age_examples(spark):
    day = 86_400
    now = datetime(2026, 4, 28, 12)
    texts = [("2026-04-28T11:59:30Z", "30s ago"), ("2026-04-28T11:55:00Z", "5m ago"), ("2026-04-28T09:00:00Z", "3h ago"),
             ("2026-04-26T12:00:00Z", "2d ago"), (None, "never"), ("garbage", "never"), ("2026-04-28T12:00:01Z", "in the future"),
             ("2026-04-28T11:59:00Z", "1m ago"), ("2026-04-28T12:00:00Z", "0s ago")]
    for days, label in ((29, "29d ago"), (30, "1mo ago"), (359, "11mo ago"), (360, "1y ago"), (719, "1y ago"), (720, "2y ago")):
        texts.append((datetime.fromtimestamp(now.timestamp() - days * day).strftime("%Y-%m-%dT%H:%M:%SZ"), label))
    df = spark.createDataFrame(texts, "at string, want string")
    label = shown.age_text(shown.age_unit(parse_iso(F.col("at")), instant("2026-04-28T12:00:00")))
    assert df.where(~label.eqNullSafe(F.col("want"))).collect() == []


def test_texts(spark):
    df = spark.createDataFrame([("hello", 5), ("hello world", None)], "s string, n bigint")
    got = df.select(
        shown.shortened(F.col("s"), 6).alias("s"), shown.number_text(F.col("n")).alias("n"),
        shown.number_text(F.lit(1000)).alias("k"), shown.number_text(F.lit(float("nan"))).alias("nan"),
        shown.date_text(F.lit("2026-04-08 10:00:00").cast("timestamp_ntz")).alias("d"),
        shown.date_text(F.lit(None).cast("timestamp_ntz")).alias("none"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("hello", "5", "1,000", "—", "Apr 8, 2026", "—"), ("hello…", "—", "1,000", "—", "Apr 8, 2026", "—")
    ]


def test_series(spark):
    rows = [("one", 0, 42.0)] + [("five", i, v) for i, v in enumerate([1.0, 4.0, 2.0, 8.0, 5.0])] + [
        ("flat", i, 3.0) for i in range(3)]
    got = reporting.series_normalised(spark.createDataFrame(rows, "series string, at int, value double")).collect()
    assert {r["series"] for r in got} == {"five", "flat"}
    five = sorted((r["x"], r["y"]) for r in got if r["series"] == "five")
    assert five == [(0.0, 0.0), (0.25, 3 / 7), (0.5, 1 / 7), (0.75, 1.0), (1.0, 4 / 7)]
    assert {r["y"] for r in got if r["series"] == "flat"} == {0.0}


def test_trend_edges(spark):
    rows = [(1, datetime(2026, 4, 20)), (1, datetime(2026, 3, 15)), (1, datetime(2026, 3, 16)), (2, datetime(2026, 4, 29)),
            (3, datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "system bigint, commit_at timestamp_ntz")
    got = {r["system"]: (r["direction"], r["change"], r["change_percent"])
           for r in reporting.trend_direction(df, instant("2026-04-30T00:00:00")).collect()}
    assert got == {1: ("down", -1, -50.0), 2: ("up", 1, None), 3: ("flat", 0, None)}
    days = reporting.daily_trend(df, instant("2026-04-30T00:00:00"), 3).where("system = 2").orderBy("day").collect()
    assert [(r["day"], r["commits"]) for r in days] == [("2026-04-28", 0), ("2026-04-29", 1), ("2026-04-30", 0)]


@pytest.mark.parametrize("shape", ["spread", "heavy_tail", "ties"])
def test_quantiles_are_exact(spark, shape):
    """One key holds most rows, above the sketch's resolution; the others are small."""
    import numpy as np

    rng = np.random.default_rng(7)
    big = {"spread": rng.uniform(0, 1e6, 60_001), "heavy_tail": rng.pareto(0.5, 60_001),
           "ties": rng.integers(0, 5, 60_001).astype(float)}[shape]
    groups = {"big": big, "two": np.array([1.0, 2.0]), "one": np.array([5.0]), "mid": rng.normal(0, 1, 777),
              None: np.array([3.0, 4.0, 8.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("big", None), ("big", float("nan")), ("none", None)]
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(16)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        for name, p in probs.items():
            assert float(got[k][name]) == pytest.approx(float(np.quantile(vs, p)), rel=1e-9, abs=1e-6), (k, name)


def test_no_system_is_lost_without_a_limit(spark):
    usage = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0)], "system bigint, amount double")
    limits = spark.createDataFrame([(1, 40.0), (3, 9.0)], "system bigint, limit double")
    got = {r["system"]: (r["used"], r["limit"], r["percent"]) for r in reporting.utilisation_report(usage, limits).collect()}
    assert got == {1: (10.0, 40.0, 25.0), 2: (1.0, None, 0.0), 3: (0.0, 9.0, 0.0)}


def test_only_whole_dates_are_times(spark):
    texts = ["2024", "2024-01", "12:30:00", "T12:30", "2024-02-30", "2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05 10:00:00+05:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_iso(F.col("t")).cast("string")).collect()]
    assert got == [None] * 5 + ["2024-01-05 00:00:00", "2024-01-05 10:00:00", "2024-01-05 05:00:00"]
    assert spark.range(1).select(instant("2026-04-28T12:00:00+05:00").cast("string")).first()[0] == "2026-04-28 07:00:00"


@pytest.mark.parametrize("n", [2, 5_000])
def test_positions_of_a_series_spread_over_tasks(spark, n):
    """One series of all rows beside small ones, among them one without a name and one too short."""
    rows = [("long", i, float(i % 97)) for i in range(n)] + [(None, 3, 1.0), (None, 1, 2.0), ("one", 1, 1.0)]
    df = spark.createDataFrame(rows, "series string, at int, value double").repartition(7)
    got = {(r["series"], r["at"]): (r["x"], r["y"]) for r in reporting.series_normalised(df).collect()}
    high = max(v for s, _, v in rows if s == "long") or 1.0
    want = {("long", i): (i / (n - 1), (i % 97) / high) for i in range(n)}
    assert got == want | {(None, 1): (0.0, 1.0), (None, 3): (1.0, 0.0)}
