"""Comparing runs: classes, invariants, exports and rankings."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evalframe.operators import compare
from evalframe.sources import bindings

SF_DIR = "/root/testdata/sf0.001"
SCORES = "run int, case_id bigint, trial bigint, score decimal(6,4)"


def scores(spark, rows):
    df = spark.createDataFrame(rows, "run int, case_id bigint, trial bigint, score double")
    return df.withColumn("score", F.col("score").cast("decimal(6,4)"))


def test_classes_and_tolerance(spark):
    df = scores(spark, [
        (1, 1, 1, 0.9), (2, 1, 1, 0.85), (1, 2, 1, 0.9), (2, 2, 1, 0.8499), (1, 3, 1, 0.9), (2, 3, 1, 0.96),
        (1, 4, 1, 0.9), (2, 5, 1, 0.9), (1, 6, 1, None), (2, 6, 1, 0.9),
        (1, 7, 1, 0.95), (1, 7, 2, 0.97), (2, 7, 1, 0.93), (2, 7, 2, 0.94), (3, 8, 1, 0.1),
    ])
    got = {r["case_id"]: r for r in compare.compare_runs(df, 1, 2, tolerance=0.05, pass_at=0.95).collect()}
    assert {k: r["change_class"] for k, r in got.items()} == {
        1: "unchanged", 2: "regressed", 3: "improved", 4: "removed", 5: "added", 6: "unscored", 7: "unchanged"}
    assert got[7]["base_score"] == 0.96 and got[7]["cand_score"] == 0.935 and got[7]["pass_to_fail"]
    assert got[2]["delta"] == -0.0501 and not got[4]["pass_to_fail"]


def test_classes_partition_the_cases(spark):
    df = bindings.run_scores(spark, SF_DIR)
    compared = compare.compare_runs(df, 1, 2)
    cases = df.where(F.col("run").isin(1, 2)).select("case_id").distinct().count()
    assert compared.count() == cases == compared.select("case_id").distinct().count()
    assert compare.class_counts(compared).agg(F.sum("cases")).first()[0] == cases


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_regressions_survive_each_format(spark, tmp_path, fmt):
    rows = [(1, c, 1, 0.9) for c in range(40)] + [(2, c, 1, 0.9 - c / 100) for c in range(40)]
    slices = spark.createDataFrame([(c, "even" if c % 2 == 0 else "odd") for c in range(39)], "case_id bigint, slice string")
    worst = compare.worst_regressions(compare.compare_runs(scores(spark, rows), 1, 2), slices, 2, 3)
    path = compare.export_regressions(worst, str(tmp_path / fmt), fmt)
    assert (tmp_path / fmt / "candidate_run=2").is_dir()
    back = compare.read_regressions(spark, path, worst.schema, fmt)
    got = sorted((r["slice"] or "", r["rank"], r["case_id"], r["delta"]) for r in back.collect())
    assert [g[:3] for g in got] == [("", 1, 39), ("even", 1, 38), ("even", 2, 36), ("even", 3, 34), ("odd", 1, 37), ("odd", 2, 35), ("odd", 3, 33)]
    assert got[1][3] == -0.38


def test_topk_limits_before_the_shuffle(spark):
    worst = compare.worst_regressions(
        compare.compare_runs(bindings.run_scores(spark, SF_DIR), 1, 2),
        bindings.table(spark, SF_DIR, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("slice")), 2, 5)
    assert worst._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_history(spark):
    df = spark.createDataFrame(
        [("v", 1, 1, "m1", 0.9), ("v", 1, 2, "m1", 1.0), ("v", 1, 3, "m2", 0.8), ("v", 1, 4, "m3", 0.97), ("v", 1, 5, "m4", 0.5), ("w", 1, 1, "m4", 0.5)],
        "variant string, case_id bigint, trial bigint, at string, score double").withColumn("score", F.col("score").cast("decimal(6,4)"))
    got = {(r["variant"], r["run_at"]): r for r in compare.run_history(df, F.col("at"), 0.95).collect()}
    assert [got[("v", m)]["score"] for m in ("m1", "m2", "m3", "m4")] == [0.95, 0.8, 0.97, 0.5]
    assert [got[("v", m)]["change"] for m in ("m1", "m2", "m3", "m4")] == [None, -0.15, 0.17, -0.47]
    assert [got[("v", m)]["best_before"] for m in ("m1", "m2", "m3", "m4")] == [None, 0.95, 0.95, 0.97]
    assert [got[("v", m)]["last_passing_run"] for m in ("m1", "m2", "m3", "m4")] == [None, "m1", "m1", "m3"]
    assert got[("w", "m4")]["best_before"] is None


@pytest.mark.parametrize("many, named", [(3, None), (16, None), (17, range(2, 12)), (60, None), (60, [0, 59])])
def test_pairwise_against_brute_force(spark, many, named):
    rows = [(v, c, t, ((v * 31 + c * 17 + t * 7) % 100) / 100) for v in range(many) for c in range(30) for t in range(2)
            if (v + c) % 4 or c > 25]
    df = scores(spark, rows).withColumnRenamed("run", "variant")
    means = {}
    for v, c, t, s in rows:
        means.setdefault((v, c), []).append(round(s * 10_000))
    means = {k: (2 * sum(u) + len(u)) // (2 * len(u)) for k, u in means.items()}
    got = {(r["variant_a"], r["variant_b"]): r for r in compare.pairwise_win_rate(df, named).collect()}
    assert set(got) == set(combinations(named or range(many), 2))
    for (a, b), r in got.items():
        both = [c for c in range(30) if (a, c) in means and (b, c) in means]
        assert r["shared"] == len(both) == r["wins"] + r["ties"] + r["losses"]
        assert r["wins"] == sum(means[a, c] > means[b, c] for c in both)
        assert r["ties"] == sum(means[a, c] == means[b, c] for c in both)


def test_leaderboard_ties_share_a_place(spark):
    rows = [(1, 1, 1, 0.9), (2, 1, 1, 0.9), (3, 1, 1, 0.8), (3, 1, 2, 0.8), (4, 1, 1, None)]
    got = {r["variant"]: (r["place"], r["cases"]) for r in compare.leaderboard(
        scores(spark, rows).withColumnRenamed("run", "variant")).collect()}
    assert (got[1], got[2], got[3]) == ((1, 1), (1, 1), (2, 1)) and got[4][1] == 0


@pytest.mark.parametrize("kind", ["double", "decimal(6,4)"])
def test_units_of_the_whole_grid(spark, kind):
    grid = spark.range(10_001).select("id", (F.col("id") / 10_000).cast(kind).alias("score"))
    assert grid.where(compare.units() != F.col("id")).count() == 0


def test_a_second_export_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "exports")
    for run in (2, 3):
        rows = [(1, 1, 1, 0.9), (run, 1, 1, 0.9 - run / 10)]
        slices = spark.createDataFrame([(1, "s")], "case_id bigint, slice string")
        worst = compare.worst_regressions(compare.compare_runs(scores(spark, rows), 1, run), slices, run, 3)
        compare.export_regressions(worst, path)
    assert sorted(r["candidate_run"] for r in compare.read_regressions(spark, path, worst.schema).collect()) == [2, 3]
