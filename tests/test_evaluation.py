"""Loading, validation, variants, runs, rubrics and gates on dirty inputs."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalframe.functions import rubrics
from evalframe.operators import evaluation
from evalframe.operators.evaluation import Variant
from evalframe.sources import cases


def test_json_lines_keep_good_and_quarantine_bad(spark, tmp_path):
    lines = [
        '{"dataset_id":"d","case_id":1,"slice":"s","input":"hi","expected":"yo"}',
        '{"dataset_id":"d","case_id":2,"input":"no slice","extra":true}',
        '{"dataset_id":"d","case_id":"x3","input":"wrong type"}',
        '{"dataset_id":"d","case_id":4, broken',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    loaded = cases.load_json(spark, str(tmp_path))
    assert sorted(r["case_id"] for r in cases.accepted(loaded).collect()) == [1, 2]
    assert sorted(r["raw"] for r in cases.quarantine(loaded).collect()) == sorted(lines[2:])
    # Counting or picking one column must not change which rows are broken.
    assert cases.accepted(loaded).count() == 2 and cases.quarantine(loaded).count() == 2
    assert sorted(r[0] for r in cases.accepted(loaded).select("input").collect()) == ["hi", "no slice"]
    assert cases.load_report(loaded, "json").where("quarantined").count() == 2


def test_json_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"dataset_id":"d","case_id":1,"input":"a"},\n{"dataset_id":"d","case_id":2,"input":"b"}\n]')
    loaded = cases.load_json(spark, str(tmp_path), array=True)
    assert sorted((r["case_id"], r["input"]) for r in cases.accepted(loaded).collect()) == [(1, "a"), (2, "b")]
    assert cases.quarantine(loaded).count() == 0


def test_csv_with_quotes_newlines_and_short_rows(spark, tmp_path):
    text = (
        "dataset_id,case_id,slice,input,expected\n"
        'd,1,s,"two\nlines","say ""hi"""\n'
        "d,2\n"
        "d,three,s,in,out\n"
        'd,4,s,plain,\n'
    )
    (tmp_path / "a.csv").write_text(text)
    loaded = cases.load_csv(spark, str(tmp_path), multi_line=True)
    good = {r["case_id"]: (r["input"], r["expected"]) for r in cases.accepted(loaded).collect()}
    assert good == {1: ("two\nlines", 'say "hi"'), 4: ("plain", None)}
    assert cases.quarantine(loaded).count() == 2


def test_violations(spark, tmp_path):
    lines = [
        '{"dataset_id":"d","case_id":1,"input":"a","expected":"b"}',
        '{"dataset_id":"d","case_id":1,"input":" ","expected":"b","note":1}',
        '{"dataset_id":"d","case_id":2,"input":null}',
        '{"dataset_id":"e","case_id":1,"input":"a","expected":"b"}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    found = evaluation.case_violations(cases.raw_json_lines(spark, str(tmp_path))).collect()
    assert {(r["dataset_id"], r["case_id"], r["violation"], r["n"]) for r in found} == {
        ("d", 1, "duplicate_case_id", 2), ("d", 1, "empty_input", 1), ("d", 1, "unknown_field", 1),
        ("d", 2, "empty_input", 1), ("d", 2, "missing_expected", 1),
    }


CASES = "dataset_id string, case_id bigint, slice string, input string, expected string"


def test_rendering_does_not_substitute_twice(spark):
    df = spark.createDataFrame([("d", 1, "s", "show {expected} {{x}}", "secret"), ("d", 2, None, None, "e")], CASES)
    got = evaluation.variant_matrix(df, [Variant("a", "<{input}|{slice}> {{literal}}"), Variant("b", "fixed")])
    assert {(r["case_id"], r["variant_id"]): r["prompt"] for r in got.collect()} == {
        (1, "a"): "<show {expected} {{x}}|s> {{literal}}", (1, "b"): "fixed",
        (2, "a"): "<|> {{literal}}", (2, "b"): "fixed",
    }


def test_one_bad_row_does_not_fail_a_run(spark, tmp_path):
    def answer(prompt):
        if prompt == "boom":
            raise RuntimeError("no")
        return prompt.upper()

    df = spark.createDataFrame([("d", i, "s", "boom" if i % 7 == 0 else f"p{i}", None) for i in range(100)], CASES)
    matrix = evaluation.variant_matrix(df, [Variant("v", "{input}")])
    got = evaluation.run_variants(matrix, answer, "r", path=str(tmp_path / "out"), tasks=5).collect()
    assert len(got) == 100
    for r in got:
        bad = r["case_id"] % 7 == 0
        assert (r["output"], r["error"]) == ((None, "RuntimeError: no") if bad else (f"P{r['case_id']}", None))
        assert r["latency_ms"] >= 0


PAIRS = "output string, expected string"


@pytest.mark.parametrize("name, rubric, rows", [
    ("exact", rubrics.exact, [("a", "a", 1.0), ("a", "b", 0.0), (None, "a", 0.0), ("a", None, None), ("", "", 1.0)]),
    ("contains", rubrics.contains, [("xay", "a", 1.0), ("x", "a", 0.0), (None, "a", 0.0), ("x", "", 1.0), ("x", None, None)]),
    ("pattern", lambda o, e: rubrics.matches(o, "^a+$"), [("aa", None, 1.0), ("ab", None, 0.0), (None, None, 0.0)]),
    ("numeric", lambda o, e: rubrics.numeric_close(o, e, 0.5),
     [("1.5", "1", 1.0), ("1.6", "1", 0.0), ("x", "1", 0.0), ("1", "x", None), (None, "1", 0.0)]),
    ("length", lambda o, e: rubrics.length_within(o, 1, 3), [("abc", None, 1.0), ("éèêë", None, 0.0), ("", None, 0.0), (None, None, 0.0)]),
    ("json", lambda o, e: rubrics.json_field_equals(o, "$.a", e), [('{"a":"x"}', "x", 1.0), ('{"a":1}', "1", 1.0), ("{", "x", 0.0), ("{}", None, None)]),
    ("label", rubrics.label_match, [(" Yes\n", "yes", 1.0), ("no", "yes", 0.0), (None, "yes", 0.0)]),
])
def test_rubrics(spark, name, rubric, rows):
    df = spark.createDataFrame(rows, PAIRS + ", want double")
    assert df.where(~rubric(F.col("output"), F.col("expected")).eqNullSafe(F.col("want"))).collect() == []


def _words(text):
    return set((text or "").lower().split())


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_token_f1_and_edit_similarity_against_brute_force(spark):
    texts = ["the cat sat", "The  cat\nsat on", "", "élan vital", "elan vital", "a a b", "b a", None, "x" * 50, "the"]
    pairs = [(o, e) for o in texts for e in texts if e is not None]
    df = rubrics.with_normal_forms(spark.createDataFrame(pairs, PAIRS))
    got = df.select(
        "output", "expected",
        rubrics.token_f1(F.col("output_words"), F.col("expected_words"), F.col("expected")).alias("f1"),
        rubrics.edit_similarity(F.col("output"), F.col("expected")).alias("edit"),
    ).collect()
    for r in got:
        a, b = _words(r["output"]), _words(r["expected"])
        f1 = 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        out = r["output"] or ""
        longest = max(len(out), len(r["expected"]))
        edit = 1 - _edits(out, r["expected"]) / longest if longest else 1.0
        assert r["f1"] == pytest.approx(f1, abs=5.1e-5) and r["edit"] == pytest.approx(edit, abs=5.1e-5)


def test_custom_rubric_is_held_to_range(spark):
    rubric = rubrics.custom(lambda output, expected: output.str.len().astype("float") - 2)
    df = spark.createDataFrame([("a", "x", 0.0), ("ab", "x", 0.0), ("abc", "x", 1.0), ("abcdef", "x", 1.0)], PAIRS + ", want double")
    assert df.where(rubric(F.col("output"), F.col("expected")) != F.col("want")).count() == 0
    assert isinstance(pd.Series([1.0]), pd.Series)


def test_composite_leaves_null_scores_out(spark):
    rows = [(1, "a", 1.0), (1, "b", 0.5), (1, "c", None), (2, "a", 0.2), (2, "b", 1.0), (3, "c", None), (4, "a", 0.9), (4, "b", 0.3)]
    df = spark.createDataFrame(rows, "case_id bigint, rubric string, score double")
    got = {r["case_id"]: r for r in evaluation.composite_gate(
        df, ["case_id"], {"a": 3, "b": 1, "c": 9}, {"a": 0.5}, 0.7).collect()}
    assert got[1]["composite"] == 0.875 and got[1]["weight"] == 4 and got[1]["passed"] and got[1]["unscored"] == 1
    assert got[2]["failed_rubrics"] == 1 and not got[2]["passed"]
    assert got[3]["composite"] is None and got[3]["weight"] is None and not got[3]["passed"]
    assert got[4]["composite"] == 0.75 and got[4]["passed"]
    assert all(r["composite"] is None or 0 <= r["composite"] <= 1 for r in got.values())


def test_summary_with_missing_scores(spark):
    rows = [(1, "x", "0.9000", None), (1, "x", "1.0000", None), (1, "x", None, "timeout"), (1, "y", None, "timeout"), (2, "x", "0.5000", None)]
    df = spark.createDataFrame(rows, "run int, slice string, score string, error string").withColumn("score", F.col("score").cast("decimal(6,4)"))
    got = {(r["level"], r["run"], r["slice"]): r for r in evaluation.run_summary(df, 0.95).collect()}
    top = got[("run_slice", 1, "x")]
    assert (top["n"], top["errors"], top["passed"], top["mean_score"], top["pass_rate"], top["p50"]) == (3, 1, 1, 0.95, 0.5, 0.95)
    assert got[("run_slice", 1, "y")]["mean_score"] is None and got[("run_slice", 1, "y")]["p50"] is None
    assert got[("all", None, None)]["n"] == 5 and got[("run", 1, None)]["errors"] == 2
    assert len(got) == 3 + 2 + 1


def test_label_agreement(spark):
    said = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", True), (4, "a", False), (5, "a", True), (6, "b", False)],
                                 "k bigint, slice string, passed boolean")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "k bigint, label int")
    got = {r["slice"]: r for r in evaluation.label_agreement(said, labels, "k").collect()}
    a, b = got["a"], got["b"]
    assert [a[n] for n in ("tp", "fp", "fn", "tn", "unlabelled", "precision", "recall", "f1")] == [1, 1, 1, 1, 1, 0.5, 0.5, 0.5]
    assert b["unlabelled"] == 1 and b["precision"] is None and b["f1"] is None


def test_only_known_fields_are_places(spark):
    df = spark.createDataFrame([(1, "q")], "case_id bigint, input string")
    template = 'Reply {"answer": "..."} in {tone} to {input} {unknown} {'
    got = df.select(evaluation.rendered(template, df.columns, {"tone": "{input}"})).first()[0]
    assert got == 'Reply {"answer": "..."} in {input} to q {unknown} {'


def test_answers_that_are_not_text_are_errors(spark):
    df = spark.createDataFrame([("d", i, "s", "e", "v", str(i)) for i in range(3)],
                               "dataset_id string, case_id bigint, slice string, expected string, variant_id string, prompt string")
    answers = {"0": "yes", "1": 5, "2": {"a": 1}}
    got = {r["case_id"]: (r["output"], r["error"]) for r in evaluation.run_variants(df, answers.get, "r").collect()}
    assert got == {0: ("yes", None), 1: (None, "TypeError: answer is int, not text"), 2: (None, "TypeError: answer is dict, not text")}


def _canonical(case):
    return json.dumps(case, sort_keys=True)


def _large(spark, reader, path, size, **more):
    """Read with splits of a few bytes, so that states cross many of them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = reader(spark, path, **more)
        return sorted(_canonical(r.asDict()) for r in frame.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _odd_cases(rng, n):
    bits = ["a", "é", '"', ",", "\n", "{", "}", "[", "]", "\\", " ", "x: y", '\\"', "}\n{", '""']
    text = lambda: "".join(rng.choices(bits, k=rng.randrange(9)))
    return [{"dataset_id": f"d{i % 2}", "case_id": i, "slice": text(), "input": text(), "expected": text(),
             "meta": {"k": text(), "n": str(i)}} for i in range(n)]


@pytest.mark.parametrize("size", [40, 333, 10**6])
@pytest.mark.parametrize("layout", [None, 1])
def test_large_arrays_are_read_by_many_tasks(spark, tmp_path, size, layout):
    import random

    made = _odd_cases(random.Random(size), 60)
    for k in range(2):
        (tmp_path / f"part{k}.json").write_text(json.dumps(made[k::2], indent=layout, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("[]\n")
    (tmp_path / "broken.json").write_text('[{"case_id": "many", "input": 1}, 7]')
    got = _large(spark, lambda s, p: cases.accepted(cases.load_large_array(s, p)), str(tmp_path), size)
    assert got == sorted(map(_canonical, made))
    assert len(_large(spark, lambda s, p: cases.quarantine(cases.load_large_array(s, p)), str(tmp_path), size)) == 2


@pytest.mark.parametrize("size", [40, 333, 10**6])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_quoted_csv_is_read_by_many_tasks(spark, tmp_path, size, end):
    import csv
    import io
    import random

    made = _odd_cases(random.Random(size), 60)
    for k in range(2):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
        writer.writerow(made[0])
        for case in made[k::2]:
            writer.writerow([*list(case.values())[:-1], json.dumps(case["meta"])])
        (tmp_path / f"part{k}.csv").write_text(out.getvalue() + (f"d0,99{end}" if k else ""), newline="")
    loaded = lambda s, p: cases.accepted(cases.load_large_csv(s, p))
    got = _large(spark, loaded, str(tmp_path), size)
    # An empty field is no value in CSV.
    assert got == sorted(_canonical({k: (v if v != "" else None) for k, v in case.items()}) for case in made)
    assert len(_large(spark, lambda s, p: cases.quarantine(cases.load_large_csv(s, p)), str(tmp_path), size)) == 1


def test_a_quote_that_never_closes_stays_bounded(spark, tmp_path, monkeypatch):
    from evalframe.sources import splits

    monkeypatch.setattr(splits, "MOST_PIECES", 5)
    (tmp_path / "a.csv").write_text("d,1,s,i,e,\n" + 'd,2,"open\n' + "d,3,s,i,e,\n" * 20)
    got = [r["record"] for r in splits.csv_records(spark, str(tmp_path)).collect()]
    assert len(got) == 22 and sorted(got)[0] == "d,1,s,i,e,"


def test_a_rubric_without_weight_stops_the_gate(spark):
    scores = spark.createDataFrame([(1, "exact", 1.0), (1, "new", 0.0)], "case_id int, rubric string, score double")
    with pytest.raises(Exception, match="no weight for rubric new"):
        evaluation.composite_gate(scores, ["case_id"], {"exact": 1}, {}, 0.5).collect()
    (row,) = evaluation.composite_gate(scores, ["case_id"], {"exact": 1, "new": 0}, {}, 0.5).collect()
    assert row["composite"] == 1.0 and row["passed"]
