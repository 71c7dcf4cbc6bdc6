"""Every registered query: the operators over whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.functions import rubrics
from evalframe.functions.fixed_values import ACTIVITY_WINDOW_DAYS
from evalframe.functions.times import instant, parse_iso
from evalframe.operators import compare, evaluation, freshness, governance, harvests, masking, reporting, telemetry
from evalframe.session import configure, shared_path
from evalframe.sources import bindings, cases
from evalframe.streaming import counters, observations, source

ASOF = bindings.ACTIVITY_ASOF
VARIANTS = (
    evaluation.Variant("plain", "{input}"),
    evaluation.Variant("polite", "Please answer briefly.\n{input}\nThank you."),
    evaluation.Variant("tagged", "[{slice}] {input} (case {case_id})"),
)
WEIGHTS = {"exact": 3, "normalised": 2, "contains": 1, "pattern": 1, "length": 1, "token_f1": 2}
THRESHOLDS = {"contains": 1.0, "token_f1": 0.2}
KEY = b"evalframe-demonstration-key"
MISSED_POLLS = 240
ALERT_POLLS = 20
OBSERVED_UNTIL = "2024-02-01T00:00:00"


# Telemetry

def t1_activity_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.activity_snapshot(bindings.commit_log(spark, sf_dir), instant(ASOF))


def t2_safety_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    wide = bindings.commit_log(spark, sf_dir).groupBy("system").agg(
        (n * 100_000).alias("commits_total"),
        ((n - 8) * 20_000).alias("commits_30d"),
        (F.nullif(F.count_if(F.col("priority") == "1-URGENT"), F.lit(0)) * 300_000).alias("repo_stars"),
        (F.floor(F.sum("amount")) * 4).cast("bigint").alias("lines_of_code"),
        (F.count_if(F.col("state") == "O") * 1_000_000).alias("open_issues"),
    )
    names = ["commits_total", "commits_30d", "repo_stars", "lines_of_code", "open_issues"]
    return telemetry.clamp_metrics(telemetry.long_metrics(wide, ["system"], names))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.response_pages(spark, sf_dir, instant(ASOF), ACTIVITY_WINDOW_DAYS)


def t3_pagination_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.pagination_totals(_pages(spark, sf_dir))


def _harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = telemetry.snapshot_lines(bindings.source_files(spark, sf_dir))
    return telemetry.with_snapshot(telemetry.harvest(_pages(spark, sf_dir)), snapshot)


def t4_harvest_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harvested(spark, sf_dir).drop("ok")


def t4_harvest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.envelope_json(_harvested(spark, sf_dir), instant(ASOF), F.lit(None).cast("timestamp"))


def t5_status_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = telemetry.resolve_status(bindings.observations(spark, sf_dir))
    return telemetry.with_snapshot(resolved, telemetry.snapshot_lines(bindings.source_files(spark, sf_dir)))


def t5_served_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole metrics row served after every harvest."""
    served = harvests.serve(harvests.assemble(bindings.harvest_pages(spark, sf_dir)))
    return harvests.with_lines(served, telemetry.snapshot_lines(bindings.source_files(spark, sf_dir)))


def t6_cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.freshness_report(bindings.observations(spark, sf_dir))


def t7_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.contract_violations(bindings.envelopes(spark, sf_dir))


def t8_lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.lines_of_code(bindings.source_files(spark, sf_dir))


def t9_primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.primary_language(bindings.source_files(spark, sf_dir))


def t9_status_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.status_board(bindings.system_statuses(spark, sf_dir))


# Reports

def f1_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = bindings.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("system"), (F.col("c_acctbal") * 1_000.0).alias("limit")
    )
    return reporting.utilisation_report(bindings.commit_log(spark, sf_dir), limits)


def f2_age_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.age_histogram(
        bindings.timestamp_texts(spark, sf_dir), parse_iso(F.col("at_text")), F.col("asof")
    )


def _scaled_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies stretched over every band, from below a millisecond to minutes."""
    k = F.pmod("id", F.lit(100)).cast("decimal(4,0)")
    scaled = F.col("latency_ms").cast("decimal(12,2)") * k * k
    return bindings.workload(spark, sf_dir).withColumn("ms", scaled.cast("decimal(24,2)"))


def f3_latency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled_latency(spark, sf_dir).withColumn("ms", F.col("ms").cast("double"))
    return reporting.latency_bands(rows, ["system"], "ms", {"p50": 0.5, "p95": 0.95})


def f3_band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.band_histogram(_scaled_latency(spark, sf_dir), "ms")


def f4_metric_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bindings.commit_log(spark, sf_dir)
    activity = telemetry.activity_snapshot(log, instant(ASOF))
    stars = log.groupBy("system").agg(
        F.nullif(F.count_if(F.col("priority") == "1-URGENT") * 1_000, F.lit(0)).alias("repo_stars")
    )
    files = telemetry.code_of_systems(bindings.source_files(spark, sf_dir, per_document=True))
    return reporting.metric_cards(activity.join(stars, "system", "left").join(files, "system", "left"))


def f5_series_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = bindings.workload(spark, sf_dir).groupBy(
        F.col("kind").alias("series"), F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd").alias("at")
    ).agg(F.sum(F.col("latency_ms").cast("decimal(18,2)")).cast("double").alias("value"))
    return reporting.series_normalised(daily)


def f6_daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.daily_trend(bindings.commit_log(spark, sf_dir), instant(ASOF))


def f7_trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.trend_direction(bindings.commit_log(spark, sf_dir), instant(ASOF))


# Streams

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.event_stream(configure(spark), sf_dir)


def s1_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "ingest")
    stream = source.observation_stream(_events(spark, sf_dir))
    source.run_to_end(observations.ingest(stream, f"{out}/rows"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").withColumn("at", F.col("at").cast("timestamp_ntz"))


def s2_last_known_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "last-good")
    stream = source.observation_stream(_events(spark, sf_dir))
    source.run_to_end(observations.last_known_good(stream, f"{out}/rows", f"{out}/state"), f"{out}/checkpoint")
    served = observations.served_rows(spark, f"{out}/rows")
    return served.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("at", "last_good_at")})


def s2_served_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole metrics rows of a stream of harvests, one per event."""
    out = shared_path(spark, "served-metrics")
    stream = source.harvest_stream(_events(spark, sf_dir))
    source.run_to_end(observations.last_good_metrics(stream, f"{out}/rows", f"{out}/state"), f"{out}/checkpoint")
    served = observations.served_rows(spark, f"{out}/rows")
    return served.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("at", "last_good_at")})


def s3_offline_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.offline_gaps(bindings.observations(spark, sf_dir), MISSED_POLLS, instant(OBSERVED_UNTIL))


def s3_offline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "alerts")
    stream = source.observation_stream(_events(spark, sf_dir))
    source.run_to_end(observations.offline_alerts(stream, f"{out}/rows", f"{out}/state", ALERT_POLLS), f"{out}/checkpoint")
    found = observations.silences(spark, f"{out}/rows", f"{out}/state", ALERT_POLLS, instant(OBSERVED_UNTIL))
    return found.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("last_seen", "back_at")})


def s3_silent_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences told while they last, by the stream's own clock."""
    out = shared_path(spark, "silent-now")
    stream = source.observation_stream(_events(spark, sf_dir))
    source.run_to_end(observations.offline_alerts(stream, f"{out}/rows", f"{out}/state", ALERT_POLLS), f"{out}/checkpoint")
    found = observations.raised_alerts(spark, f"{out}/rows")
    return found.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("last_seen", "raised_at")})


def s4_latest_per_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "latest")
    stream = source.observation_stream(_events(spark, sf_dir))
    source.run_to_end(observations.upsert_latest(stream, f"{out}/state"), f"{out}/checkpoint")
    latest = observations.latest_version(spark, f"{out}/state")
    return latest.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("last_poll_at", "data_at")})


def _streamed_counters(spark: SparkSession, sf_dir: str, window, purpose: str) -> DataFrame:
    out = shared_path(spark, purpose)
    rows = source.workload_stream(_events(spark, sf_dir))
    counted = counters.counters(rows, window, ["kind"], "1 hour")
    source.run_to_end(counters.persist_updates(counted, f"{out}/rows"), f"{out}/checkpoint")
    return counters.current_counters(spark, f"{out}/rows", counted)


def s5_tumbling_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_counters(spark, sf_dir, counters.tumbling("1 day"), "tumbling")


def s5_sliding_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_counters(spark, sf_dir, counters.sliding("1 day", "12 hours"), "sliding")


def s5_session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bindings.workload(configure(spark), sf_dir).withColumn("at", F.col("at").cast("timestamp"))
    return counters.session_counters(rows, "12 hours", ["actor", "kind"])


def s5_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "sessions")
    rows = source.workload_stream(_events(spark, sf_dir))
    counted = counters.session_counters(rows, "12 hours", ["actor", "kind"], "1 hour")
    source.run_to_end(counters.append_closed(counted, f"{out}/rows"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


def s5_session_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of the stream, those still open among them."""
    out = shared_path(spark, "session-updates")
    keys = ["actor", "kind"]
    rows = source.workload_stream(_events(spark, sf_dir))
    source.run_to_end(counters.session_updates(rows, f"{out}/rows", "12 hours", keys, "1 hour"), f"{out}/checkpoint")
    return counters.all_sessions(spark, f"{out}/rows", keys, "actor bigint, kind string")


# Evaluation

def _case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as files hold them; system turns stand for broken records."""
    good = bindings.eval_cases(spark, sf_dir)
    fields = evaluation.CASE_FIELDS

    def quoted(name: str):
        text = F.regexp_replace(F.col(name).cast("string"), '"', '""')
        return F.when(text.isNotNull(), F.concat(F.lit('"'), text, F.lit('"')))

    lines = good.select(
        F.to_json(F.struct(*fields)).alias("json"),
        F.concat_ws(",", *[F.coalesce(quoted(name), F.lit("")) for name in fields]).alias("csv"),
    )
    ids = bindings.turn_id().cast("string")
    broken = bindings.table(spark, sf_dir, "conversations").where(F.col("role") == "system").select(
        F.concat(F.lit('{"case_id": '), ids, F.lit(', "input"')).alias("json"),
        F.concat(F.lit("chat,"), ids).alias("csv"),
    )
    return lines.unionByName(broken)


def e1_load_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "cases")
    lines = _case_lines(spark, sf_dir)
    lines.select("json").write.text(f"{out}/json")
    lines.select("csv").write.text(f"{out}/csv")
    from_json = cases.load_report(cases.load_json(spark, f"{out}/json"), "json")
    from_csv = cases.load_report(cases.load_csv(spark, f"{out}/csv", header=False, multi_line=True), "csv")
    return from_json.unionByName(from_csv)


def _write_arrays(records: DataFrame, path: str) -> None:
    """One JSON array per partition of ``records`` (a column ``json``), one record a line."""
    numbered = records.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    order = Window.partitionBy("part").orderBy("at")
    opening = F.when(F.row_number().over(order) == 1, "[").otherwise(",")
    closing = F.when(F.lead("at").over(order).isNull(), "]").otherwise("")
    lines = numbered.select("part", "at", F.concat(opening, F.col("json"), closing).alias("line"))
    lines.repartition("part").sortWithinPartitions("part", "at").select("line").write.text(path)


def e1_load_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with ``meta`` from array files and from quoted CSV with a header, both split over tasks."""
    out = shared_path(spark, "large-cases")
    good = bindings.eval_cases(spark, sf_dir).withColumn(
        "meta", F.create_map(F.lit("turn"), F.pmod("case_id", F.lit(2**32)).cast("string"))
    )
    broken = bindings.table(spark, sf_dir, "conversations").where(F.col("role") == "system").select(
        F.to_json(F.struct(F.lit("chat").alias("dataset_id"), F.concat(F.lit("id "), bindings.turn_id().cast("string")).alias("case_id"))).alias("json")
    )
    _write_arrays(good.select(F.to_json(F.struct(*evaluation.CASE_FIELDS, "meta")).alias("json")).unionByName(broken), f"{out}/json")
    good.withColumn("meta", F.to_json("meta")).write.options(header=True, quoteAll=True, escape='"').csv(f"{out}/csv")
    loaded = cases.load_report(cases.load_large_array(spark, f"{out}/json"), "array").unionByName(
        cases.load_report(cases.load_large_csv(spark, f"{out}/csv"), "csv")
    )
    return loaded.withColumn("turn", F.col("meta")["turn"]).drop("meta")


def e2_case_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets out of the same turns: by turn, and by conversation with repeated ids."""
    opening = F.col("slice") == "opening"
    fields = evaluation.CASE_FIELDS
    by_turn = F.struct(
        "dataset_id", "case_id", "input",
        F.when(opening, F.to_json(F.struct(*fields, F.col("slice").alias("note"))))
        .otherwise(F.to_json(F.struct(*fields))).alias("raw"),
    )
    by_conversation = F.struct(
        F.lit("conversation").alias("dataset_id"), F.shiftright("case_id", 32).alias("case_id"),
        F.when(opening, F.col("input")).otherwise(F.lit("  ")).alias("input"),
        F.to_json(F.struct(*fields)).alias("raw"),
    )
    both = bindings.eval_cases(spark, sf_dir).select("expected", F.explode(F.array(by_turn, by_conversation)).alias("c"))
    return evaluation.case_violations(both.select("c.*", "expected"))


def e3_variant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.variant_matrix(bindings.eval_cases(spark, sf_dir), VARIANTS).drop("expected")


def e4_run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def answer(prompt: str) -> str:
        if "ing" in prompt:
            raise ValueError("prompt not allowed")
        return "answer: " + prompt.strip(" ").replace("\n", " / ")

    matrix = evaluation.variant_matrix(bindings.eval_cases(spark, sf_dir), VARIANTS)
    outputs = evaluation.run_variants(matrix, answer, "run-1")
    return outputs.select("run_id", "dataset_id", "case_id", "variant_id", "output", "error")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic answers to every case that has an expected text."""
    answers = F.explode(F.array(
        F.struct(F.lit("echo").alias("variant"), F.col("expected").alias("output")),
        F.struct(F.lit("loose").alias("variant"), F.concat(F.lit("  "), F.lower("expected"), F.lit("\n")).alias("output")),
        F.struct(F.lit("quote").alias("variant"), F.col("input").alias("output")),
    ))
    return bindings.eval_cases(spark, sf_dir).select("case_id", "expected", answers.alias("a")).select(
        "case_id", "expected", "a.*"
    )


def e5_rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, expected = F.col("output"), F.col("expected")
    return evaluation.rubric_scores(
        rubrics.with_normal_forms(_answers(spark, sf_dir)), ["case_id", "variant"],
        {
            "exact": rubrics.exact(output, expected),
            "normalised": rubrics.exact(F.col("output_normal"), F.col("expected_normal")),
            "contains": rubrics.contains(output, expected),
            "pattern": rubrics.matches(output, r"(tion|ment)[ .]"),
            "length": rubrics.length_within(output, 100, 600),
            "token_f1": rubrics.token_f1(F.col("output_words"), F.col("expected_words"), expected),
        },
        {"token_f1": 0.5},
    )


def e5_value_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bindings.table(spark, sf_dir, "events").select(
        "event_id", "props", F.col("event_type").alias("kind"), F.col("value").cast("string").alias("number"),
        F.get_json_object("props", "$.k").alias("k"), F.floor("value").cast("string").alias("whole"),
    )
    said = F.when(F.col("kind") == "view", F.lit(" VIEW ")).otherwise(F.col("kind"))
    want = F.when(F.col("k").cast("int") < 50, "view").when(F.col("k").cast("int") < 90, "click")
    return evaluation.rubric_scores(
        events, ["event_id"],
        {
            "numeric": rubrics.numeric_close(F.col("number"), F.col("k"), 5.0),
            "json_field": rubrics.json_field_equals(F.col("props"), "$.k", F.col("whole")),
            "label": rubrics.label_match(said, want),
            "edit": rubrics.edit_similarity(F.col("kind"), want),
        },
        {"edit": 0.5},
    )


def e5_custom_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own vectorised rubric beside the built-in ones."""
    ratio = rubrics.custom(lambda output, expected: output.str.len().astype("float64") / expected.str.len().astype("float64"))
    scores = {"length_ratio": ratio(F.col("output"), F.col("expected"))}
    return evaluation.rubric_scores(_answers(spark, sf_dir), ["case_id", "variant"], scores, {"length_ratio": 0.5})


def e6_composite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = e5_rubric_scores(spark, sf_dir)
    return evaluation.composite_gate(scores, ["case_id", "variant"], WEIGHTS, THRESHOLDS, 0.6)


def e_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, matrix, answers, scores, gate, comparison of two variants, exported regressions."""
    def answer(prompt: str) -> str:
        return prompt.strip(" ").replace("\n", " / ")

    asked = bindings.eval_cases(spark, sf_dir)
    outputs = evaluation.run_variants(evaluation.variant_matrix(asked, VARIANTS[:2], trials=2), answer, "chain")
    ids = ["case_id", "variant_id", "trial"]
    scores = evaluation.rubric_scores(outputs, ids, {
        "length": rubrics.length_within(F.col("output"), 40, 300),
        "pattern": rubrics.matches(F.col("output"), r"(tion|ment)[ .]"),
        "contains": rubrics.contains(F.col("output"), F.lit("ing")),
    })
    gated = evaluation.composite_gate(scores, ids, {"length": 3, "pattern": 2, "contains": 1}, {}, 0.5)
    runs = gated.select("case_id", "trial", F.col("variant_id").alias("run"), F.col("composite").alias("score"))
    worst = compare.worst_regressions(
        compare.compare_runs(runs, "plain", "polite"), asked.select("case_id", "slice"), "polite", 25
    )
    return compare.read_regressions(spark, compare.export_regressions(worst), worst.schema)


def e7_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_summary(bindings.run_scores(spark, sf_dir), 0.95)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_runs(bindings.run_scores(spark, sf_dir), 1, 2)


def e8_compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


def e8_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.class_counts(_compared(spark, sf_dir))


def e9_export_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = bindings.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("slice")
    )
    worst = compare.worst_regressions(_compared(spark, sf_dir), brands, 2, 5)
    path = compare.export_regressions(worst)
    return compare.read_regressions(spark, path, worst.schema)


def _variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.run_scores(spark, sf_dir).withColumnRenamed("run", "variant")


def e10_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.col("at").cast("timestamp"), "yyyy-MM")
    return compare.run_history(_variant_scores(spark, sf_dir), month, 0.95)


def e11_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.leaderboard(_variant_scores(spark, sf_dir))


def e11_pairwise_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pairwise_win_rate(_variant_scores(spark, sf_dir))


def e12_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = (rubrics.length_within(F.col("text"), 200, 4_000) == 1) & (rubrics.matches(F.col("text"), r"[#$%&*]{3}") == 0)
    predictions = bindings.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("slice"), passed.alias("passed")
    )
    labels = bindings.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return evaluation.label_agreement(predictions, labels, "doc_id")


def e13_audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bindings.table(spark, sf_dir, "conversations").withColumn("artifact", bindings.turn_id())
    recorded = turns.where(F.col("role").isin("system", "user"))
    found = turns.where(F.col("role").isin("user", "assistant")).withColumn(
        "text", F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    )
    fields = ["role", "text"]
    return governance.audit_diff(
        governance.manifest(recorded, "artifact", fields), governance.manifest(found, "artifact", fields)
    )


def e13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bindings.table(spark, sf_dir, "conversations")
    return governance.manifest(turns, "conv_id", ["role", "text"])


def e14_private_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.private_log(bindings.workload(spark, sf_dir), KEY)


def e14_private_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = bindings.workload(spark, sf_dir).withColumn("day", F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd"))
    return governance.private_counts(daily, ["system", "kind", "day"], 3)


def e14_masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.masked_texts(bindings.table(spark, sf_dir, "documents"), "doc_id")


def e15_workload_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.workload_counters(bindings.workload(spark, sf_dir))


def e15_persisted_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a log that is recorded as it comes: purchases arrive late, for every day."""
    path = shared_path(spark, "workload-counters")
    log = bindings.workload(spark, sf_dir)
    late = F.col("kind") == "purchase"
    governance.record_rows(log.where(~late), log.where(~late), path)
    governance.record_rows(log.where(late), log, path)
    return governance.recorded_counters(spark, path)


REGISTERED = (
    t1_activity_snapshot, t2_safety_clamp, t3_pagination_total, t4_harvest_envelope, t4_harvest_json,
    t5_status_resolution, t5_served_metrics, t6_cache_freshness, t7_contract_violations, t8_lines_of_code,
    t9_primary_language, t9_status_board,
    f1_utilisation, f2_age_histogram, f3_latency_bands, f3_band_histogram, f4_metric_cards,
    f5_series_normalised, f6_daily_trend, f7_trend_direction,
    s1_stream_ingest, s2_last_known_good, s2_served_metrics, s3_offline_gaps, s3_offline_alerts, s3_silent_now,
    s4_latest_per_system,
    s5_tumbling_counters, s5_sliding_counters, s5_session_counters, s5_session_stream, s5_session_updates,
    e1_load_cases, e1_load_large_files, e2_case_violations, e3_variant_matrix, e4_run_outputs, e5_rubric_scores,
    e5_value_rubrics, e5_custom_rubric, e6_composite_gate, e_chain, e7_run_summary, e8_compare_runs, e8_class_counts,
    e9_export_regressions, e10_run_history, e11_leaderboard, e11_pairwise_win_rate,
    e12_label_agreement, e13_audit_diff, e13_manifest, e14_private_log, e14_private_counts,
    e14_masked_text, e15_workload_counters, e15_persisted_counters,
)
