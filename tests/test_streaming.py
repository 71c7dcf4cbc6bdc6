"""Streams over several files against their batch twins."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalframe.operators import harvests, telemetry
from evalframe.sources import bindings
from evalframe.streaming import counters, observations, source, state

SF_DIR = "/root/testdata/sf0.001"
PARTS = 4


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in time order as several files, so that state crosses batches."""
    base = tmp_path_factory.mktemp("events")
    events = bindings.table(spark, SF_DIR, "events")
    edges = events.approxQuantile("event_id", [i / PARTS for i in range(1, PARTS)], 0.0)
    part = sum((F.col("event_id") > edge).cast("int") for edge in edges)
    numbered = events.withColumn("part", part)
    for i in range(PARTS):
        numbered.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(str(base / f"part{i}"))
    import os
    import shutil

    flat = tmp_path_factory.mktemp("flat")
    for i in range(PARTS):
        (found,) = (base / f"part{i}").glob("*.parquet")
        target = flat / f"events-{i}.parquet"
        shutil.copy(found, target)
        os.utime(target, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return str(flat)


def events(spark, folder):
    return source.event_stream(spark, folder, "events-*.parquet", files_per_batch=1)


def rows(df, *names):
    return sorted(df.select(*names).collect(), key=repr)


def test_ingest_equals_batch(spark, folder, tmp_path):
    stream = source.observation_stream(events(spark, folder))
    source.run_to_end(observations.ingest(stream, str(tmp_path / "out")), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("at", F.col("at").cast("timestamp_ntz"))
    names = ["system", "at", "id", "ok", "value"]
    assert rows(got, *names) == rows(bindings.observations(spark, SF_DIR), *names)


def test_last_known_good_equals_batch_over_many_batches(spark, folder, tmp_path):
    stream = source.observation_stream(events(spark, folder))
    query = observations.last_known_good(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    source.run_to_end(query, str(tmp_path / "c"))
    assert len(list((tmp_path / "out").glob("version=*"))) == PARTS
    got = observations.served_rows(spark, str(tmp_path / "out"))
    got = got.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("at", "last_good_at")})
    names = ["system", "at", "id", "status", "served_value", "last_good_at"]
    assert rows(got, *names) == rows(telemetry.resolve_status(bindings.observations(spark, SF_DIR)), *names)


def test_latest_equals_batch_and_errors_erase_nothing(spark, folder, tmp_path):
    stream = source.observation_stream(events(spark, folder))
    source.run_to_end(observations.upsert_latest(stream, str(tmp_path / "state")), str(tmp_path / "c"))
    names = ["system", "last_poll_at", "last_ok", "data_at", "data_id", "data_value"]
    got = observations.latest_version(spark, str(tmp_path / "state"))
    got = got.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("last_poll_at", "data_at")})
    want = rows(observations.latest_per_system(bindings.observations(spark, SF_DIR)), *names)
    assert rows(got, *names) == want
    assert any(not r["last_ok"] and r["data_value"] is not None for r in want)


@pytest.mark.parametrize("shape", ["tumbling", "sliding"])
def test_counters_equal_batch_over_many_batches(spark, folder, tmp_path, shape):
    window = counters.tumbling("1 day") if shape == "tumbling" else counters.sliding("1 day", "12 hours")
    keys = ["kind"]
    counted = counters.counters(source.workload_stream(events(spark, folder)), window, keys, "1 hour")
    source.run_to_end(counters.persist_updates(counted, str(tmp_path / "out")), str(tmp_path / "c"))
    batch = bindings.workload(spark, SF_DIR).withColumn("at", F.col("at").cast("timestamp"))
    names = ["window_start", "window_end", *keys, "requests", "errors", "latency_ms"]
    got = counters.current_counters(spark, str(tmp_path / "out"), counted)
    assert rows(got, *names) == rows(counters.counters(batch, window, keys), *names)


def test_sessions_are_appended_when_closed(spark, folder, tmp_path):
    gap, keys = "12 hours", ["actor", "kind"]
    counted = counters.session_counters(source.workload_stream(events(spark, folder)), gap, keys, "1 hour")
    source.run_to_end(counters.append_closed(counted, str(tmp_path / "out")), str(tmp_path / "c"))
    batch = bindings.workload(spark, SF_DIR).withColumn("at", F.col("at").cast("timestamp"))
    newest = batch.agg(F.max("at").cast("timestamp_ntz")).first()[0]
    whole = counters.session_counters(batch, gap, keys)
    closed = whole.where(F.col("window_end") <= F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR"))
    names = ["window_start", "window_end", *keys, "requests", "errors", "latency_ms"]
    got = rows(spark.read.parquet(str(tmp_path / "out")), *names)
    want = rows(closed, *names)
    assert got == want
    assert closed.count() < whole.count()


def test_filtering_sessions_does_not_cut_them(spark):
    from datetime import datetime

    rows_ = [(1, "a", datetime(2026, 1, 1, h), 1.0) for h in (0, 8, 16)]
    df = spark.createDataFrame(rows_, "actor bigint, kind string, at timestamp, latency_ms double")
    found = counters.session_counters(df, "12 hours", ["actor", "kind"]).where("window_end <= timestamp_ntz '2026-01-01 20:00:00'")
    assert found.count() == 0


def _write(spark, folder, number, times):
    import os
    from datetime import datetime

    schema = source.EVENT_SCHEMA
    data = [(i, datetime.fromisoformat(t), user, "view", 1.0, "{}") for i, (t, user) in enumerate(times)]
    path = folder / f"tmp{number}"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(path))
    (found,) = path.glob("*.parquet")
    target = folder / f"events-{number}.parquet"
    target.write_bytes(found.read_bytes())
    os.utime(target, (1_700_000_000 + number * 10, 1_700_000_000 + number * 10))


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    _write(spark, tmp_path, 0, [("2026-01-01 10:00:00", 1)])
    _write(spark, tmp_path, 1, [("2026-01-03 10:00:00", 1)])
    _write(spark, tmp_path, 2, [("2026-01-03 09:30:00", 1)])
    # A batch drops rows older than the watermark its predecessor ran with.
    _write(spark, tmp_path, 3, [("2026-01-03 09:40:00", 1), ("2026-01-01 11:00:00", 1)])
    _write(spark, tmp_path, 4, [("2026-01-05 00:00:00", 1)])
    counted = counters.counters(
        source.workload_stream(events(spark, str(tmp_path))), counters.tumbling("1 day"), ["kind"], "1 hour")
    source.run_to_end(counters.persist_updates(counted, str(tmp_path / "out")), str(tmp_path / "c"))
    got = counters.current_counters(spark, str(tmp_path / "out"), counted).orderBy("window_start").collect()
    assert [(r["window_start"].day, r["requests"]) for r in got] == [(1, 1), (3, 3), (5, 1)]


@pytest.mark.parametrize("files", [1, 3, 10])
def test_offline_alerts_do_not_depend_on_batches(spark, tmp_path, files):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(1)
    start = datetime(2026, 1, 1)
    rows = sorted((start + timedelta(seconds=rng.randrange(90_000)), rng.randrange(6)) for _ in range(240))
    rows += [(start + timedelta(hours=31), 1)]
    observed = spark.createDataFrame([(s, t, i) for i, (t, s) in enumerate(rows)], "system bigint, at timestamp, id bigint")
    want = telemetry.offline_gaps(observed, 20, F.lit(datetime(2026, 1, 3)).cast("timestamp")).collect()
    size = -(-len(rows) // files)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(files):
        observed.where(f"id div {size} = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(observed.schema).parquet(str(tmp_path / "in"))
        source.run_to_end(observations.offline_alerts(stream, out, state, 20), str(tmp_path / "c"))
    got = observations.silences(spark, out, state, 20, F.lit(datetime(2026, 1, 3)).cast("timestamp")).collect()
    key = lambda r: (r["system"], r["last_seen"], r["silent_s"], r["back_at"] or start)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 20


def test_a_late_row_still_sees_the_known_value(spark, tmp_path):
    from datetime import datetime

    schema = "system bigint, at timestamp, id bigint, ok boolean, value double"
    folder = tmp_path / "obs"
    first = spark.createDataFrame([(1, datetime(2026, 1, 2), 1, True, 7.0)], schema)
    second = spark.createDataFrame([(1, datetime(2026, 1, 1), 2, False, 0.0), (1, datetime(2026, 1, 3), 3, False, 0.0)], schema)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for frame in (first, second):
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        source.run_to_end(observations.last_known_good(stream, out, state), str(tmp_path / "c"))
    got = {r["id"]: (r["status"], r["served_value"]) for r in observations.served_rows(spark, out).collect()}
    assert got == {1: ("operational", 7.0), 2: ("degraded", 7.0), 3: ("degraded", 7.0)}


def _folders(path):
    return [p for p in path.rglob("*") if p.is_dir()]


def _in_batches(spark, tmp_path, frame, order, files, start):
    """Run ``start(stream)`` over the rows of ``frame`` in ``files`` batches, a fresh query for each."""
    n = frame.count()
    size = -(-n // files)
    for k in range(files):
        frame.where((F.col(order) >= k * size) & (F.col(order) < (k + 1) * size)).drop("_order").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        source.run_to_end(start(spark.readStream.schema(frame.drop("_order").schema).parquet(str(tmp_path / "in"))), str(tmp_path / "c"))


METRICS = ("system bigint, at timestamp, id bigint, ok boolean, commits_30d bigint, commits_total bigint, repo_stars bigint, "
           "primary_language string, last_commit_at string")


@pytest.mark.parametrize("files", [1, 3, 8])
def test_streamed_metrics_equal_batch_after_restarts(spark, tmp_path, files):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(files)
    rows_ = [(0 if i % 3 else rng.randrange(1, 5), datetime(2026, 1, 1) + timedelta(seconds=i * 7), i, rng.random() < 0.5, i, i * 2, i * 3,
              f"l{i}", None if i % 4 else f"d{i}") for i in range(200)]
    frame = spark.createDataFrame(rows_, METRICS)
    out, at = str(tmp_path / "out"), str(tmp_path / "state")
    _in_batches(spark, tmp_path, frame, "id", files, lambda stream: observations.last_good_metrics(stream, out, at))
    got = observations.served_rows(spark, out)
    want = harvests.serve(frame.withColumnsRenamed({"at": "harvested_at", "id": "harvest_id"})).withColumnsRenamed(
        {"harvested_at": "at", "harvest_id": "id"})
    assert rows(got, *want.columns) == rows(want, *want.columns)
    table = state.StateTable(spark, at)
    assert spark.read.parquet(f"{at}/rows/batch={table.commit().batch}").count() <= 5


def test_fifty_batches_leave_few_folders_and_a_replay_changes_nothing(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path / "state"))
    schema = "system bigint, n bigint"
    made = lambda pairs: spark.createDataFrame(pairs, schema).select(state.hashed(["system"], 4), "*")

    def step(batch):
        fresh = made([(batch % 7, batch), (100 + batch % 3, batch)])
        touched = state.buckets_of(fresh)
        known = table.rows(table.commit(batch), fresh.drop("bucket").schema, touched).select(state.hashed(["system"], 4), "*")
        newest = known.unionByName(fresh).groupBy("bucket", "system").agg(F.max("n").alias("n"))
        table.write(batch, newest, touched, {"clock": batch})

    now = lambda: rows(table.rows(table.commit(), made([(0, 0)]).drop("bucket").schema), "system", "n")
    seen = 0
    for batch in range(50):
        step(batch)
        seen = max(seen, len(_folders(tmp_path)))
    want = {system: max(b for b in range(50) if b % 7 == system) for system in range(7)}
    want |= {100 + r: max(b for b in range(50) if b % 3 == r) for r in range(3)}
    assert {r["system"]: r["n"] for r in now()} == want
    # At most two folders per bucket, with the folders above them.
    assert seen <= 4 * 2 * 2 + 4 and len(list((tmp_path / "state" / "commits").glob("[0-9]*.json"))) <= 2
    before = now()
    step(49)
    assert now() == before and table.commit().values == {"clock": 49}


def test_a_bucket_that_empties_leaves_the_commit(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path / "state"))
    frame = spark.createDataFrame([(1, 1), (2, 2)], "system bigint, n bigint").select(F.col("system").cast("string").alias("bucket"), "*")
    table.write(0, frame, ["1", "2"], {})
    table.write(1, frame.where("system = 2"), ["1"], {})
    assert set(table.commit().written) == {"2"} and table.commit(1).written == {"1": 0, "2": 0}
    assert table.rows(table.commit(), frame.drop("bucket").schema, ["1"]).count() == 0


def test_a_fleet_that_goes_quiet_raises_alerts_by_itself(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2026, 1, 1)
    schema = "system bigint, at timestamp, id bigint"
    batches = [
        [(s, start + timedelta(seconds=s), s) for s in range(5)],  # all are there
        [(0, start + timedelta(seconds=500), 10)],  # only one still is: four fall silent
        [(0, start + timedelta(seconds=700), 11), (9, start, 12)],  # told once; one comes in overdue
        [(1, start + timedelta(seconds=710), 13), (0, start + timedelta(seconds=720), 14)],  # one is back
        [(0, start + timedelta(seconds=1_900), 15)],
    ]
    out, at = str(tmp_path / "out"), str(tmp_path / "state")
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        source.run_to_end(observations.offline_alerts(stream, out, at, 10), str(tmp_path / "c"))
    got = sorted((int((r["raised_at"] - start).total_seconds()), r["system"], int((r["last_seen"] - start).total_seconds()))
                 for r in observations.raised_alerts(spark, out).collect())
    assert got == [(500, 1, 1), (500, 2, 2), (500, 3, 3), (500, 4, 4), (700, 9, 0), (1_900, 1, 710)]
    ended = observations.silences(spark, out, at, 10, F.lit(None).cast("timestamp")).where("back_at IS NOT NULL").collect()
    assert sorted((r["system"], r["silent_s"]) for r in ended) == [(0, 500), (0, 1_180), (1, 709)]


KEYS = ["actor", "kind"]


@pytest.mark.parametrize("files", [1, 4, 9])
def test_all_sessions_of_any_batches_equal_the_whole(spark, tmp_path, files):
    batch = bindings.workload(spark, SF_DIR).withColumn("at", F.col("at").cast("timestamp")).select(*KEYS, "at", "latency_ms", "id")
    start = lambda stream: counters.session_updates(stream, str(tmp_path / "out"), "12 hours", KEYS, "1 hour")
    ordered = batch.select("*", (F.row_number().over(Window.orderBy("at", "id")) - 1).alias("_order"))
    _in_batches(spark, tmp_path, ordered, "_order", files, start)
    got = counters.all_sessions(spark, str(tmp_path / "out"), KEYS, "actor bigint, kind string")
    whole = counters.session_counters(batch, "12 hours", KEYS)
    assert rows(got, *whole.columns) == rows(whole, *whole.columns)
    table = state.StateTable(spark, str(tmp_path / "out" / "open"))
    assert files == 1 or sum(1 for _ in (tmp_path / "out" / "closed").rglob("*.parquet")) > 0
    assert len(table.commit().written) <= state.BUCKETS


def test_a_late_row_joins_two_open_sessions(spark, tmp_path):
    from datetime import datetime

    schema = "actor bigint, kind string, at timestamp, latency_ms double"
    day = lambda h, m=0: datetime(2026, 1, 1, h, m)
    out = str(tmp_path / "out")
    for times in ([day(1), day(4)], [day(2, 30)], [day(9)], [day(1, 10), day(6)]):
        spark.createDataFrame([(1, "a", t, 1.5) for t in times], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        source.run_to_end(counters.session_updates(stream, out, "2 hours", KEYS, "4 hours"), str(tmp_path / "c"))
    got = rows(counters.all_sessions(spark, out, KEYS, "actor bigint, kind string"), "window_start", "window_end", "requests", "latency_ms")
    # 01:10 came after the watermark of 05:00 had passed its end, 06:00 did not.
    assert [tuple(r) for r in got] == [(day(1), day(6), 3, 4.5), (day(6), day(8), 1, 1.5), (day(9), day(11), 1, 1.5)]
