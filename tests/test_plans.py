"""What the physical plans of the registered queries must and must not hold."""

from __future__ import annotations

import importlib
import re

import pytest

from evalframe.operators import compare
from evalframe.plans import queries as registered
from evalframe.sources import bindings

ENTRY = importlib.import_module("__spark_entry__")
QUERIES = {query.__name__: ENTRY.queries()[query.__name__] for query in registered.REGISTERED}
SF_DIR = "/root/testdata/sf0.001"
STREAMED = {"s1_stream_ingest", "s2_last_known_good", "s2_served_metrics", "s3_offline_alerts", "s3_silent_now",
            "s4_latest_per_system", "s5_tumbling_counters", "s5_sliding_counters", "s5_session_stream", "s5_session_updates"}
PYTHON = {"e4_run_outputs", "e5_custom_rubric"}
# A query that ends in a handful of rows on purpose: one row per variant.
SINGLE = {"e11_leaderboard"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans as at scale: no side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {name: plan(query(spark, SF_DIR)) for name, query in QUERIES.items() if name not in STREAMED}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_pair_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_no_row_leaves_the_jvm(plans):
    for name, text in plans.items():
        assert name in PYTHON or not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text), name


def test_nothing_is_gathered_into_one_task(plans):
    for name, text in plans.items():
        assert name in SINGLE or "SinglePartition" not in text, name


@pytest.mark.parametrize("name, exchanges", [
    ("t1_activity_snapshot", 1), ("t2_safety_clamp", 1), ("t7_contract_violations", 0), ("f2_age_histogram", 1),
    ("f6_daily_trend", 1), ("f7_trend_direction", 1), ("e5_value_rubrics", 0), ("e8_compare_runs", 1),
    ("e13_manifest", 1), ("e14_private_log", 0), ("e14_masked_text", 0), ("s5_session_counters", 1),
])
def test_shuffle_counts(plans, name, exchanges):
    assert len(re.findall(r"\bExchange ", plans[name])) == exchanges


def test_filters_and_columns_reach_the_scan(plans):
    assert "PushedFilters: [In(l_linenumber, [1,2])]" in plans["e8_compare_runs"]
    assert "ReadSchema: struct<l_orderkey" not in plans["e8_compare_runs"]
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual(o_orderdate" in plans["t1_activity_snapshot"]
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plans["t1_activity_snapshot"]
    assert "text" not in re.search(r"ReadSchema: struct<[^>]*>", plans["e14_private_log"]).group()


def test_counts_combine_before_the_shuffle(plans):
    for name in ("t1_activity_snapshot", "e7_run_summary", "e8_compare_runs", "e14_private_counts", "e13_manifest"):
        assert "partial_" in plans[name], name


def test_text_is_reduced_before_the_label_join(plans):
    exchanges = re.findall(r"Exchange hashpartitioning\(doc_id.*\n[^\n]*Project \[([^\n]*)\]", plans["e12_label_agreement"])
    assert exchanges and all(", text#" not in columns for columns in exchanges)


def test_pairs_are_counted_in_one_pass(spark):
    df = compare.pairwise_win_rate(bindings.run_scores(spark, SF_DIR).withColumnRenamed("run", "variant"), range(1, 8))
    assert "Join" not in plan(df) and "Python" not in plan(df)
