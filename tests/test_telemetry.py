"""Telemetry examples and edges the given tables do not hold."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evalframe.functions.times import instant
from evalframe.operators import freshness, harvests, telemetry
from evalframe.operators.ordered import last_known, next_time, with_chunks

T0 = datetime(2026, 4, 28, 12, 0, 0)
OBSERVED = "system bigint, at timestamp_ntz, id bigint, ok boolean, value double"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def test_clamp_examples(spark):
    cases = [
        ("repo_stars", 99_999_999, 1_000_000), ("commits_total", 50_000_000, 1_000_000),
        ("commits_30d", 500_000, 100_000), ("lines_of_code", 999_999_999, 10_000_000),
        ("not_a_field", 42, 42), ("repo_stars", None, None), ("repo_stars", -5, -5),
        ("repo_stars", 1_000_000, 1_000_000), ("repo_stars", 999_999, 999_999), (None, 7, 7),
    ]
    df = spark.createDataFrame(cases, "metric string, value bigint, want bigint")
    once = telemetry.clamp_metrics(df)
    assert once.where(~F.col("capped").eqNullSafe(F.col("want"))).count() == 0
    twice = once.select("metric", F.col("capped").alias("value"), F.col("capped").alias("want"))
    assert telemetry.clamp_metrics(twice).where(~F.col("capped").eqNullSafe(F.col("want"))).count() == 0


def test_page_totals(spark):
    two = ('<https://h/c?per_page=1&page=2>; rel="next", <https://h/c?per_page=1&page={}>; rel="last"')
    cases = [
        (two.format(42), "[1]", 42), (two.format(99), "[1]", 99),
        (None, "[1,2,3]", 3), ("", "[]", 0),
        ('<https://h/c?per_page=1>; rel="last"', "[1]", 1),
        ('<https://h/c?page=7&per_page=1>; rel="last"', "[1]", 7),
        ('<https://h/c?page=7>; rel="first"', "[1]", 1),
        (two.format("9" * 40), "[1]", 2**63 - 1),
        (None, "{broken", None),
    ]
    df = spark.createDataFrame(cases, "link string, body string, want bigint")
    got = df.withColumn("got", telemetry.page_total(F.col("link"), F.col("body")))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def _pages(system, repo, latest, recent, link=None):
    return [(system, "repo", None, repo), (system, "latest", link, latest), (system, "recent", link, recent)]


def test_harvest_and_envelope(spark):
    commit = '[{"commit":{"author":{"date":"2026-04-26T12:00:00Z"}}}]'
    link = '<https://h/c?per_page=1&page=2>; rel="next", <https://h/c?per_page=1&page=42>; rel="last"'
    rows = (
        _pages(1, '{"stargazers_count":7,"language":"Python"}', commit, commit, link)
        + _pages(2, '{"stargazers_count":null,"language":""}', "[]", "[]")
        + _pages(3, "{broken", commit, commit)
        + _pages(4, '{"stargazers_count":99999999,"language":null}', '[{"commit":null}]', "[]")
        + [(5, "repo", None, '{"stargazers_count":1}')]
        + _pages(6, "[]", commit, commit)
        + _pages(7, '{"stargazers_count":"many"}', commit, commit)
        + _pages(8, '{"stargazers_count":1}', '{"message":"slow down"}', commit, link)
        + _pages(9, "{}", commit, "[]")
    )
    pages = spark.createDataFrame(rows, "system bigint, kind string, link string, body string")
    got = {r["system"]: r for r in telemetry.harvest(pages).collect()}
    assert (got[1]["repo_stars"], got[1]["commits_total"], got[1]["primary_language"]) == (7, 42, "Python")
    assert got[1]["last_commit_at"] == "2026-04-26T12:00:00Z" and got[1]["status"] == "operational"
    assert (got[2]["repo_stars"], got[2]["commits_total"], got[2]["primary_language"]) == (0, 0, "Unknown")
    assert got[2]["last_commit_at"] is None and got[2]["ok"]
    assert got[3]["status"] == "degraded" and got[3]["commits_total"] == 0 and got[3]["last_commit_at"] is None
    assert got[4]["repo_stars"] == 1_000_000 and got[4]["commits_total"] == 1
    assert {got[i]["status"] for i in (5, 6, 7, 8)} == {"degraded"}
    assert got[9]["ok"] and got[9]["repo_stars"] == 0 and got[9]["commits_30d"] == 0

    snapshot = spark.createDataFrame([(1, 1177), (2, 0)], "system bigint, lines_of_code bigint")
    whole = telemetry.with_snapshot(telemetry.harvest(pages), snapshot)
    texts = telemetry.envelope_json(whole, instant("2026-04-28T12:00:00"), F.lit(None).cast("timestamp"))
    told = {r["system"]: json.loads(r["envelope"]) for r in texts.collect()}
    assert told[1]["metrics"]["lines_of_code"] == 1177
    assert "lines_of_code" not in told[2]["metrics"]
    assert told[2]["last_commit_at"] is None and "last_deployed_at" in told[2]
    assert told[1]["generated_at"] == "2026-04-28T12:00:00Z" and told[1]["schema_version"] == 1


PAGES = "system bigint, id bigint, kind string, link string, body string, fetched_at timestamp_ntz"
COMMIT = '[{"commit":{"author":{"date":"2026-04-25T08:00:00Z"}}}]'


def _last(n):
    return f'<https://h/c?per_page=1&page=2>; rel="next", <https://h/c?per_page=1&page={n}>; rel="last"'


def _harvest(system, begin, first_id, stars, total, language="Go"):
    """The three pages of one harvest, two seconds apart."""
    repo = '{"stargazers_count":%s,"language":"%s"}' % (stars, language)
    return [(system, first_id, "repo", None, repo, at(begin)), (system, first_id + 1, "latest", _last(total), COMMIT, at(begin + 2)),
            (system, first_id + 2, "recent", None, COMMIT, at(begin + 4))]


def _served(spark, pages, **more):
    frame = spark.createDataFrame(pages, PAGES)
    return harvests.serve(harvests.assemble(frame, **more), **more).orderBy("system", "harvested_at", "harvest_id").collect()


@pytest.mark.parametrize("target", [1, 4, 1_000])
def test_harvests_stay_apart_and_failures_serve_the_last_good_row(spark, target):
    pages = _harvest(1, 0, 1, 50, 7, "Rust") + _harvest(1, 600, 11, 40, 9, "Ada")
    # A failed first harvest, a good one of 11 stars and 99 commits, then three failures.
    pages += [(2, 1, "repo", None, "{broken", at(0)), (2, 2, "latest", None, COMMIT, at(2)), (2, 3, "recent", None, COMMIT, at(4))]
    pages += _harvest(2, 400, 4, 11, 99)
    pages += [(2, 20, "repo", None, '{"stargazers_count":5}', at(800))]
    pages += [(2, 30, "repo", None, '{"stargazers_count":5}', at(900)), (2, 31, "latest", _last(3), COMMIT, at(902)),
              (2, 32, "recent", None, '{"message":"slow down"}', at(904))]
    pages += [(2, 40, "repo", None, "[]", at(1_000)), *_harvest(2, 1_000, 41, 6, 6)[1:]]
    got = [r.asDict() for r in _served(spark, pages, target_rows=target)]
    assert [(r["repo_stars"], r["commits_total"], r["primary_language"], r["status"]) for r in got if r["system"] == 1] == [
        (50, 7, "Rust", "operational"), (40, 9, "Ada", "operational")]
    two = [r for r in got if r["system"] == 2]
    assert [(r["status"], r["repo_stars"], r["commits_total"], r["primary_language"]) for r in two] == [
        ("degraded", 0, 0, "Unknown"), ("operational", 11, 99, "Go"), *[("degraded", 11, 99, "Go")] * 3]
    assert [r["last_good_at"] for r in two] == [None] + [at(400)] * 4
    assert two[0]["last_commit_at"] is None and two[4]["last_commit_at"] == "2026-04-25T08:00:00Z"


def test_pages_out_of_order_and_retried(spark):
    pages = _harvest(1, 0, 1, 50, 7)
    pages += [(1, 4, "latest", _last(8), COMMIT, at(6)), (1, 5, "latest", _last(9), COMMIT, at(13)), (1, 0, "latest", _last(5), COMMIT, at(-1))]
    (row,) = _served(spark, pages[::-1])
    # The retried page counts, one after twelve seconds does not, nor one before any harvest.
    assert (row["commits_total"], row["repo_stars"], row["harvest_id"]) == (8, 50, 1)
    assert _served(spark, []) == []


def test_lines_survive_a_failed_harvest(spark):
    pages = [(1, 1, "repo", None, "{", at(0))]
    snapshot = spark.createDataFrame([(1, 1_177), (2, 5)], "system bigint, lines_of_code bigint")
    served = harvests.serve(harvests.assemble(spark.createDataFrame(pages, PAGES)))
    (row,) = harvests.with_lines(served, snapshot).collect()
    assert (row["status"], row["commits_total"], row["lines_of_code"]) == ("degraded", 0, 1_177)


def test_status_falls_back_to_last_good(spark):
    rows = [
        (1, at(0), 1, False, 5.0), (1, at(1), 2, True, 11.0), (1, at(2), 3, False, 0.0),
        (1, at(3), 4, True, None), (1, at(4), 5, True, float("nan")), (1, at(4000), 6, False, None),
        (1, at(8000), 8, True, 99.0), (1, at(8000), 7, False, None), (2, at(5), 9, None, 3.0),
    ]
    got = {r["id"]: r for r in telemetry.resolve_status(spark.createDataFrame(rows, OBSERVED)).collect()}
    assert [got[i]["served_value"] for i in range(1, 10)] == [0.0, 11.0, 11.0, 11.0, 11.0, 11.0, 11.0, 99.0, 0.0]
    assert [i for i in got if got[i]["status"] == "operational"] and got[4]["status"] == "degraded"
    assert got[1]["last_good_at"] is None and got[6]["last_good_at"] == at(1)


def test_freshness_is_strict(spark):
    rows = [
        (1, at(0), 1, True, 1.0), (1, at(299), 2, False, 1.0), (1, at(300), 3, False, 1.0),
        (1, at(301), 4, True, 1.0), (1, at(302), 5, True, 1.0), (2, at(0), 6, False, 1.0),
        (3, at(0), 7, True, 1.0), (3, at(60), 8, True, 1.0), (3, at(240), 9, True, 1.0), (3, at(480), 10, True, 1.0),
    ]
    got = {r["id"]: r for r in freshness.freshness(spark.createDataFrame(rows, OBSERVED)).collect()}
    assert [got[i]["cache_class"] for i in range(1, 7)] == ["refetch", "hit", "stale", "refetch", "hit", "empty"]
    assert [got[i]["data_age_s"] for i in range(1, 7)] == [0, 299, 300, 0, 1, None]
    assert [got[i]["cache_class"] for i in range(7, 11)] == ["refetch", "hit", "hit", "refetch"]
    assert got[9]["data_age_s"] == 240


def _walked(rows, ttl):
    """Every system's polls walked one after the other."""
    want, last = {}, {}
    for system, when, i, ok, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        fetched = last.get(system)
        age = None if fetched is None else (when - fetched).total_seconds()
        if age is not None and age < ttl:
            want[i] = ("hit", int(age))
        elif ok:
            want[i], last[system] = ("refetch", 0), when
        else:
            want[i] = ("empty", None) if age is None else ("stale", int(age))
    return want


def _fresh(spark, rows, ttl=300):
    got = freshness.freshness(spark.createDataFrame(rows, OBSERVED), ttl).collect()
    return {r["id"]: (r["cache_class"], r["data_age_s"]) for r in got}


@pytest.mark.parametrize(("span", "fan_bits", "ttl"), [(8, 6, 300), (1, 1, 300), (2, 1, 7), (3, 2, 60), (8, 6, 1)])
def test_freshness_equals_a_walk(spark, monkeypatch, span, fan_bits, ttl):
    """Stretches of any length, joined in trees of any width, with one system in a third of the rows."""
    import random

    monkeypatch.setattr(freshness, "SPAN", span)
    monkeypatch.setattr(freshness, "FAN_BITS", fan_bits)
    rng, rows = random.Random(ttl * span), []
    for i in range(900):
        system = 0 if i % 3 == 0 else rng.randrange(1, 4)
        # Steady polls, bursts, silences over years, equal times, and times before 1970.
        when = rng.choice([i * 30, rng.randrange(0, 9_000), 5_000, -1_800_000_000 - i, 90_000_000 + rng.randrange(100_000), i * 30.5])
        rows.append((system, at(when), i, rng.random() < 0.7, 1.0))
    assert _fresh(spark, rows, ttl) == _walked(rows, ttl)


def test_one_system_with_all_rows(spark):
    """Dense polls never pause for a lifetime, so every fetch depends on the first of all."""
    import random

    rng = random.Random(3)
    rows = [(1, at(i * 7 + rng.random() * 6), i, rng.random() < 0.8, 1.0) for i in range(30_000)]
    assert _fresh(spark, rows) == _walked(rows, 300)


def test_steady_polls_fetch_once_a_lifetime(spark):
    rows = [(1, at(30 * i), i, True, 1.0) for i in range(400)]
    got = freshness.freshness(spark.createDataFrame(rows, OBSERVED)).where("cache_class = 'refetch'").collect()
    assert sorted(r["id"] for r in got) == list(range(0, 400, 10))


@pytest.mark.parametrize("target", [1, 7, 50, 10_000])
def test_chunked_look_back_equals_plain_order(spark, target):
    """A key with a third of all rows, cut into chunks of any size, gives the plain result."""
    import random

    rng = random.Random(target)
    rows = []
    for i in range(600):
        system = 0 if i % 3 == 0 else rng.randrange(1, 8)
        # Bursts, equal times and an hour-wide spread, before and after the epoch.
        second = rng.choice([rng.randrange(-7_300, 7_300), rng.randrange(0, 20), 5])
        rows.append((system, datetime(1970, 1, 1) + timedelta(seconds=second), i, rng.random() < 0.3, float(i)))
    df = spark.createDataFrame(rows, OBSERVED)
    seen = last_known(df, "system", "at", "id", F.col("ok"), F.col("value"), "got", target_rows=target)
    prior = last_known(df, "system", "at", "id", F.col("ok"), F.col("value"), "got", before=True, target_rows=target)
    ahead = next_time(df, "system", "at", "id", "got", target_rows=target)
    for system in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == system), key=lambda r: (r[1], r[2]))
        last, want_seen, want_prior, want_next = None, {}, {}, {}
        for i, row in enumerate(mine):
            want_prior[row[2]] = last
            last = row[4] if row[3] else last
            want_seen[row[2]] = last
            want_next[row[2]] = mine[i + 1][1] if i + 1 < len(mine) else None
        for frame, want in ((seen, want_seen), (prior, want_prior), (ahead, want_next)):
            assert {r["id"]: r["got"] for r in frame.where(F.col("system") == system).collect()} == want


def test_hot_hour_is_split(spark):
    rows = [(1, T0 + timedelta(seconds=i), i, True, 0.0) for i in range(3_000)] + [(2, T0, 9_999, True, 0.0)]
    # Most of the hour falls into one minute of it.
    rows += [(1, T0 + timedelta(milliseconds=i * 15), 10_000 + i, True, 0.0) for i in range(4_000)]
    df = spark.createDataFrame(rows, OBSERVED)
    sizes = with_chunks(df, "system", "at", target_rows=100).groupBy("system", "_chunk").count().collect()
    assert max(r["count"] for r in sizes if r["system"] == 1) <= 150
    assert sum(r["count"] for r in sizes) == len(rows)


def test_contract_rules(spark):
    good = ("sys", "live", "operational", "2026-04-28T12:00:00Z", "2026-04-28T12:00:00Z", 1, 1, 1, 1, 1, "2026-04-28T12:00:00Z")
    names = ["system", "mode", "status", "last_commit_at", "last_deployed_at", "commits_30d", "commits_total",
             "repo_stars", "lines_of_code", "schema_version", "generated_at"]
    changes = [
        ({}, set()), ({"system": None}, {"system_missing"}), ({"mode": None}, set()), ({"mode": "demo"}, {"mode_enum"}),
        ({"status": "down"}, set()), ({"status": None}, {"status_enum"}), ({"status": "offline"}, {"status_enum"}),
        ({"last_commit_at": None}, set()), ({"last_commit_at": "garbage"}, {"last_commit_at_unreadable"}),
        ({"schema_version": None}, {"schema_version"}), ({"generated_at": None}, {"generated_at_zone"}),
        ({"generated_at": "2026-04-28T12:00:00"}, {"generated_at_zone"}),
        ({"commits_30d": 100_000}, set()), ({"commits_30d": 100_001}, {"commits_30d_above_cap"}),
        ({"repo_stars": -1}, {"repo_stars_negative"}), ({"lines_of_code": None}, set()),
        ({"generated_at": "soonZ", "status": "x"}, {"generated_at_unreadable", "status_enum"}),
    ]
    rows = [(i, *[{**dict(zip(names, good)), **change}[n] for n in names]) for i, (change, _) in enumerate(changes)]
    schema = ("id int, system string, mode string, status string, last_commit_at string, last_deployed_at string, "
              "commits_30d bigint, commits_total bigint, repo_stars bigint, lines_of_code bigint, schema_version int, generated_at string")
    found = telemetry.contract_violations(spark.createDataFrame(rows, schema)).collect()
    for i, (_, want) in enumerate(changes):
        assert {r["rule"] for r in found if r["id"] == i} == want, changes[i]


def test_line_counts_and_paths(spark):
    texts = [("", 0), ("a\nb", 2), ("a\nb\n", 2), ("a\r\nb", 2), ("a\rb", 1), ("\n", 1), ("\n\n", 2), ("x", 1)]
    df = spark.createDataFrame(texts, "text string, want bigint")
    assert df.where(telemetry.line_count(F.col("text")) != F.col("want")).count() == 0
    paths = [
        ("src/a.py", ".py"), ("src/a.tar.json", ".json"), ("src/.gitignore", ""), ("src/Makefile", ""),
        ("a.d/file", ""), ("src/__init__.py", ".py"), ("src/..py", ".py"), ("src/A.PY", ".PY"), ("b.", ""),
    ]
    df = spark.createDataFrame(paths, "path string, want string")
    assert df.where(telemetry.suffix_of(F.col("path")) != F.col("want")).collect() == []


def test_lines_of_code_filters(spark):
    files = [
        (1, "src/a.py", "x\ny"), (1, "src/b.PY", "x"), (1, "node_modules/m/c.js", "x"), (1, "src/build/d.ts", "x"),
        (1, "src/builder/e.ts", "x\n"), (1, "out/stats.json", "x"), (1, ".hidden.md", "x"), (1, "_x.md", ""),
    ]
    df = spark.createDataFrame(files, "system bigint, path string, text string")
    got = {r["suffix"]: (r["files"], r["lines"]) for r in telemetry.lines_of_code(df, ["out/stats.json"]).collect()}
    assert got == {".py": (1, 2), ".ts": (1, 1), ".md": (2, 1), "(all)": (4, 4)}


def test_primary_language_unknown_and_ties(spark):
    files = [(1, "a.py", "Go", "a\nb"), (1, "b.ts", "Rust", "a\nb"), (1, "c.md", None, "a\nb\nc"), (2, "d.md", None, "a"),
             (1, "node_modules/e.py", "Go", "a\nb\nc\nd")]
    df = spark.createDataFrame(files, "system bigint, path string, language string, text string")
    got = {r["system"]: (r["primary_language"], r["language_lines"]) for r in telemetry.primary_language(df).collect()}
    assert got == {1: ("Rust", 2), 2: ("Unknown", 0)}


def test_tones(spark):
    cases = [
        ("operational", True, "success", "success", "success"), ("degraded", True, "warning", "warning", "warning"),
        ("down", True, "danger", "warning", "muted"), (None, False, "danger", "warning", "muted"),
        (None, True, "muted", "warning", "muted"),
    ]
    df = spark.createDataFrame(cases, "status string, reachable boolean, header string, overview string, telemetry string")
    shown = telemetry.tones(F.col("status"), F.col("reachable"))
    for place, tone in shown.items():
        assert df.where(~tone.eqNullSafe(F.col(place))).collect() == [], place


def test_offline_gaps(spark):
    rows = [(1, at(0), 1, True, 0.0), (1, at(90), 2, True, 0.0), (1, at(181), 3, True, 0.0), (1, at(9_999), 4, True, 0.0)]
    asof = F.lit(at(10_500))
    gaps = telemetry.offline_gaps(spark.createDataFrame(rows, OBSERVED), 3, asof).orderBy("last_seen").collect()
    assert [(r["last_seen"], r["back_at"], r["silent_s"]) for r in gaps] == [
        (at(90), at(181), 91), (at(181), at(9_999), 9_818), (at(9_999), None, 501)]


def test_activity_window_edge(spark):
    asof = "2026-04-30T00:00:00"
    rows = [(1, 1, datetime(2026, 3, 31)), (1, 2, datetime(2026, 3, 30, 23, 59, 59)), (2, 3, datetime(2020, 1, 1)),
            (1, 4, datetime(2026, 5, 1))]
    df = spark.createDataFrame(rows, "system bigint, commit_id bigint, commit_at timestamp_ntz")
    got = {r["system"]: (r["commits_total"], r["commits_30d"]) for r in telemetry.activity_snapshot(df, instant(asof)).collect()}
    assert got == {1: (2, 1), 2: (1, 0)}


def test_language_of_a_system_has_most_lines(spark):
    files = [(1, "a.py", "Python", "x\n" * 5), (1, "b.ts", "TypeScript", "x\n" * 3), (1, "c.ts", "TypeScript", "x\n" * 3), (2, "d.md", None, "x")]
    df = spark.createDataFrame(files, "system int, path string, language string, text string")
    got = {r["system"]: (r["lines_of_code"], r["primary_language"]) for r in telemetry.code_of_systems(df).collect()}
    assert got == {1: (11, "TypeScript"), 2: (1, None)}
