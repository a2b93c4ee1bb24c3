"""Streams against their batch twins under reordering, small batches and restarts."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from gatewise.operators import reports, sensors
from gatewise.streaming import jobs, late, runtime
from gatewise.streaming.keyed import KeyedTable

SCHEMA = "lane string, ts timestamp_ntz, seq long, kind string, loops array<boolean>"


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(11)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.choice([0.02, 0.3, 1.0, 4.0, 20.0])
        kind = rng.choice(["state"] * 7 + ["heartbeat", "disconnect"])
        loops = [rng.random() < 0.6, rng.random() < 0.5] if kind == "state" else None
        rows.append((rng.choice(["hot", "hot", "l2"]), at, i, kind, loops))
    df = spark.createDataFrame(rows, "lane string, at double, seq long, kind string, loops array<boolean>")
    return df.select("lane", (F.timestamp_micros((F.col("at") * 1e6).cast("long"))).cast("timestamp_ntz").alias("ts"), "seq", "kind", "loops")


def spill(df, path, n_files=6, jitter=3):
    """Write in ``n_files`` arrival batches, each row up to ``jitter`` places away from its time order."""
    rows = df.orderBy("ts", "seq").collect()
    rng = random.Random(5)
    rows = [r for _, r in sorted((i + rng.uniform(0, jitter), r) for i, r in enumerate(rows))]
    size = -(-len(rows) // n_files)
    for i in range(n_files):
        df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(f"{path}/part={i:02d}")


def stream_of(spark, df, path):
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(path)).select(*df.columns)
    )


CLOCK = "TIMESTAMP_NTZ '1970-01-02 00:00:00'"


def passes(df):
    return sorted(tuple(r) for r in df.select("lane", "entry_ts", "exit_engage_ts", "exit_clear_ts", "end_ts", "outcome").collect())


def test_passes_survive_reordering_and_restart(spark, messages, tmp_path):
    # A late heartbeat per lane pushes the watermark past everything; it is the clock of the batch twin too.
    ends = messages.select("lane").distinct().select(
        "lane", F.expr(CLOCK).alias("ts"), F.lit(10**9).cast("long").alias("seq"), F.lit("heartbeat").alias("kind"),
        F.lit(None).cast("array<boolean>").alias("loops"))
    want = passes(sensors.detect_passes(
        messages.unionByName(ends).withColumn("ts", F.when(F.col("seq") == 10**9, F.expr(CLOCK + " - INTERVAL 100 SECONDS")).otherwise(F.col("ts"))),
        max_s=30.0, chunk_s=600.0))
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    spill(messages, source)
    run = lambda: runtime.run_available(
        jobs.detect_passes_stream(stream_of(spark, messages, source), max_s=30.0, delay="100 seconds"), "p", check, out)
    first = passes(run())
    spill(ends, str(source / "tail"), 1)
    second = passes(run())  # restarted from the checkpoint
    assert set(first) <= set(second) and len(second) > len(first)
    assert second == want


def test_kpis_refresh_per_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", f"lane{i % 2}", i % 3, i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, lane_name string, admission int, foreign_object_detected boolean").select(
        "id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "lane_name", "admission", "foreign_object_detected")
    for i in range(3):
        df.filter(F.col("id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = stream_of(spark, df, tmp_path / "in")
    got = runtime.run_updates(jobs.live_kpis(stream, delay="10 days"), "kpis", ["window_start", "lane_name"])
    want = df.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("window_start"), "lane_name").agg(
        F.count("*").alias("total"), F.count_if(F.col("admission") == 0).alias("approved"),
        F.count_if(F.col("admission") == 2).alias("denied"), F.count_if("foreign_object_detected").alias("threats"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_newest_events_view(spark, tmp_path):
    df = spark.range(40).select(F.col("id"), (F.col("id") * 2).alias("v"))
    write = jobs.newest_events_writer(str(tmp_path / "view"), 10)
    for epoch in range(4):
        write(df.filter(F.col("id") % 4 == epoch), epoch)
        write(df.filter(F.col("id") % 4 == epoch), epoch)  # replay
    view = spark.read.parquet(str(tmp_path / "view" / "v3"))
    assert sorted(view.collect()) == sorted(reports.recent_events(df, 10).collect())


def entries(df):
    return sorted((tuple(r) for r in df.select("lane", "engaged_ts", "entry_ts").collect()), key=repr)


def step_by_step(spark, df, path, n=4, jitter=3):
    """Arrivals of ``df`` a few places out of order, and the stream over what has come."""
    rng = random.Random(7)
    rows = [r for _, r in sorted((i + rng.uniform(0, jitter), r) for i, r in enumerate(df.orderBy("ts", "seq").collect()))]
    size = -(-len(rows) // n)
    spark.createDataFrame([], df.schema).write.parquet(path)
    bring = lambda k: spark.createDataFrame(rows[k * size:(k + 1) * size], df.schema).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), [lambda k=k: bring(k) for k in range(n)]


def test_debounce_timers_are_armed_and_cancelled(spark, messages, tmp_path):
    states = messages.filter("kind = 'state'")
    newest = states.agg({"ts": "max"}).first()[0]
    # The last lane's engagement has no later row of its own: only the timer can tell it.
    alone = spark.createDataFrame([("alone", newest - datetime.timedelta(seconds=5), 10**6, "state", [True, False]),
                                   (None, newest - datetime.timedelta(seconds=4), 10**6 + 1, "state", [True, None]),
                                   ("gone", newest - datetime.timedelta(seconds=4), 10**6 + 2, "state", [True, False]),
                                   ("gone", newest - datetime.timedelta(seconds=3), 10**6 + 3, "state", [None, True])], states.schema)
    states = states.unionByName(alone)
    stream, steps = step_by_step(spark, states, str(tmp_path / "in"))
    got = entries(runtime.run_to_end(spark, lambda ends: jobs.debounced_entries_stream(stream, 2.0, "100 seconds", ends), "entries", 100.0, arrivals=steps))
    want = entries(sensors.debounced_entries(states, 2.0, chunk_s=600.0, until=newest))
    assert got == want and {"alone", "hot"} <= {r[0] for r in got} and "gone" not in {r[0] for r in got}
    assert entries(sensors.debounced_entries(states, 2.0)) != want


def test_closed_streams_equal_their_batch_twins(spark, messages, tmp_path):
    newest = messages.agg({"ts": "max"}).first()[0]
    stream, steps = step_by_step(spark, messages, str(tmp_path / "a"))
    got = runtime.run_to_end(spark, lambda ends: jobs.loop_state_stream(stream, delay="100 seconds", ends=ends), "levels", 100.0, arrivals=steps)
    want = sensors.loop_state(messages).select("lane", "seq", F.concat_ws("", F.transform("loops", lambda b: F.when(b, "1").otherwise("0"))).alias("vector"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stream, steps = step_by_step(spark, messages, str(tmp_path / "b"))
    got = runtime.run_to_end(spark, lambda ends: jobs.detect_passes_stream(stream, max_s=30.0, delay="100 seconds", ends=ends), "passes", 100.0, arrivals=steps)
    assert passes(got) == passes(sensors.detect_passes(messages, max_s=30.0, chunk_s=600.0, until=newest))
    beats = messages.filter("kind = 'heartbeat'")
    stream, steps = step_by_step(spark, beats, str(tmp_path / "c"))
    got = runtime.run_to_end(spark, lambda ends: jobs.liveness_stream(stream, ["lane"], 60.0, "100 seconds", ends), "alive", 100.0, 60.0, arrivals=steps)
    want = sensors.liveness(beats, ["lane"], 60.0)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_closing_an_empty_stream(spark, messages, tmp_path):
    stream, steps = step_by_step(spark, messages.limit(0), str(tmp_path / "in"), 2)
    got = runtime.run_to_end(spark, lambda ends: jobs.loop_state_stream(stream, ends=ends), "levels", 10.0, arrivals=steps)
    assert got.count() == 0


def test_late_rows_are_split_off_and_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "split")
    at = lambda *s: spark.createDataFrame([(i, None if x is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=x)) for i, x in s],
                                          "seq long, ts timestamp_ntz")
    write = late.split_writer(path, 10.0)
    batches = [at((1, 100), (2, 5)), at((3, 90), (4, 91), (5, None), (6, 200)), at(), at((7, 190), (8, 190.001), (9, 20), (10, 900))]
    for epoch, batch in enumerate(batches):
        write(batch, epoch)
        write(batch, epoch)
    schema = batches[0].schema
    stored = spark.read.parquet(f"{path}/rows")
    assert sorted(r["seq"] for r in stored.filter("NOT late").collect()) == [1, 2, 4, 5, 6, 8, 10]
    assert sorted(r["seq"] for r in late.rejected(spark, path, schema).collect()) == [3, 7, 9]
    # A job timed by the clock takes every accepted row, however they come.
    stream = late.accepted_stream(spark, path, schema).select(F.lit("x").alias("lane"), "ts", "seq", F.lit("state").alias("kind"), F.array(F.lit(True)).alias("loops"), "clock")
    got = runtime.run_to_end(spark, lambda ends: jobs.loop_state_stream(stream.filter("ts IS NOT NULL"), 1, "10 seconds", ends), "levels", 10.0,
                             newest=lambda: late.newest(spark, path))
    assert sorted(r["seq"] for r in got.collect()) == [1, 2, 4, 6, 8, 10]


def test_keyed_table_stays_small_and_replays(spark, tmp_path):
    path = str(tmp_path / "table")
    table = KeyedTable(spark, path, ["k"], compact_after=4)
    want, sizes = {}, []
    for epoch in range(50):
        rows = [(None if k == 0 else k, epoch * 10 + k, None if k == 3 else "x") for k in range(8) if (k + epoch) % 3 == 0]
        batch = spark.createDataFrame(rows, "k long, v long, note string").coalesce(1)
        table.write(batch, epoch)
        if epoch % 7 == 0:
            table.write(batch, epoch)  # a replay
        want |= {k: (v, note) for k, v, note in rows}
        sizes.append(sum(len(files) for _, _, files in os.walk(path)))
        if epoch in (3, 4, 5, 49):
            got = {r["k"]: (r["v"], r["note"]) for r in KeyedTable(spark, path, ["k"]).read().collect()}
            assert got == want
    assert max(sizes[25:]) <= max(sizes[:25]) <= 60


def test_keyed_table_of_an_empty_epoch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), ["k"])
    table.write(spark.createDataFrame([], "k long, v long"), 0)
    assert table.read().count() == 0
    table.write(spark.createDataFrame([(1, 2), (1, 5)], "k long, v long"), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, 5)]


def test_held_rows_come_hour_by_hour():
    """Rows of a key are read an hour at a time, in order, and those behind the watermark stay."""
    import random

    from gatewise.streaming.processors import HeldRows

    class Texts(list):
        get, put = list.copy, lambda self, rows: self.__setitem__(slice(None), rows)
        appendList = list.extend

    texts, hour = Texts(), HeldRows.HOUR_US
    held = HeldRows(type("Handle", (), {"getListState": lambda self, *_: texts})())
    rows = [[random.Random(i).randrange(6 * hour), i, str(i)] for i in range(2000)]
    for at in range(0, 2000, 300):
        held.add(rows[at : at + 300])
    mark = 3 * hour + hour // 2
    first = list(held.due(mark))
    assert len(first) == 4 and max(map(len, first)) < 500
    assert [r for part in first for r in part] == sorted(r for r in rows if r[0] <= mark)
    assert held.least == min(r[0] for r in rows if r[0] > mark)
    assert [r for part in held.due(9 * hour) for r in part] == sorted(r for r in rows if r[0] > mark)
    assert held.least is None and not texts


def test_passes_and_frames_meet_across_batches_and_replay_changes_nothing(spark, tmp_path):
    """The epochs give the batch form's pairs, each once; held rows go behind the watermark; late rows are dropped."""
    from gatewise.streaming import joined

    second = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rng = random.Random(5)
    passes = [(i, rng.choice("ab"), second(i * 7.0), second(i * 7.0 + rng.choice([5, 60])) if i % 3 else None) for i in range(80)]
    frames = [(i, rng.choice("ab"), second(i * 2.0 + 0.5), "driver") for i in range(280)]
    df_p = lambda rows: spark.createDataFrame(rows, "pass_id long, lane string, entry_ts timestamp_ntz, exit_clear_ts timestamp_ntz")
    df_f = lambda rows: spark.createDataFrame(rows, "frame_id long, lane string, ts timestamp_ntz, camera string")
    # Passes run ahead of or behind their frames by up to three epochs.
    epochs = [([p for p in passes if (p[0] + p[0] % 3 * 10) // 20 == k], [f for f in frames if (f[0] + f[0] % 4 * 20) // 70 == k]) for k in range(6)]
    assert sum(len(p) for p, _ in epochs) == 80 and sum(len(f) for _, f in epochs) == 280
    path = str(tmp_path / "j")
    write = joined.pass_frames_writer(path, ["pass_id", "frame_id"], 30.0, 600.0)
    for k, (p, f) in enumerate(epochs):
        for _ in range(2 if k == 2 else 1):
            write(joined.both_streams(df_p(p), df_f(f)), k)
    got = sorted((r.pass_id, r.frame_id) for r in spark.read.parquet(f"{path}/rows").collect())
    want = sorted((r.pass_id, r.frame_id) for r in sensors.frames_in_pass(df_p(passes), df_f(frames), 30.0).collect())
    assert got == want and len(got) > 300
    write(joined.both_streams(df_p([(900, "a", second(9000.0), None)]), df_f([(900, "a", second(9001.0), "driver")])), 6)
    assert {tuple(r) for r in spark.read.parquet(f"{path}/held/v6").select("pass.pass_id", "frame.frame_id").collect()} == {(900, None), (None, 900)}
    write(joined.both_streams(df_p([(901, "a", second(8000.0), None)]), df_f([(901, "a", second(9002.0), "driver")])), 7)
    last = {tuple(r) for r in spark.read.parquet(f"{path}/rows/epoch=7").select("pass_id", "frame_id").collect()}
    assert last == {(900, 901)} and os.listdir(f"{path}/held") and sorted(os.listdir(f"{path}/held")) == ["v6", "v7"]


def test_the_pass_and_frame_stream_meets_in_batches(spark, monkeypatch):
    """Its pairs come from joins of whole batches, not from look-ups in a state store."""
    from gatewise.plans import catalog  # noqa: F401
    from gatewise.plans.registry import QUERIES

    monkeypatch.setattr(jobs, "pass_frames_stream", None)
    assert QUERIES["st7_pass_frames_stream"](spark, "/root/testdata/sf0.001").count() == QUERIES["j3_frames_in_pass"](spark, "/root/testdata/sf0.001").count()


def test_rows_in_time_are_stored_instead_of_their_pairs(spark, tmp_path):
    """Read as pairs, they are those of the writer of pairs, epoch by epoch; late rows, null times and replays change nothing."""
    from gatewise.streaming import joined

    second = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rng = random.Random(8)
    passes = [(i, rng.choice(["a", "b", None]), second(i * 7.0) if i % 13 else None, second(i * 7.0 + rng.choice([-20, 5, 60])) if i % 3 else None) for i in range(80)]
    frames = [(i, rng.choice(["a", "b", None]), second(i * 2.0) if i % 17 else None) for i in range(280)] * 2
    df_p = lambda rows: spark.createDataFrame(rows, "pass_id long, lane string, entry_ts timestamp_ntz, exit_clear_ts timestamp_ntz")
    df_f = lambda rows: spark.createDataFrame(rows, "frame_id long, lane string, ts timestamp_ntz")
    # With a delay of a minute, rows that come an epoch behind (140 s) are late.
    epochs = [joined.both_streams(df_p([p for p in passes if (p[0] + p[0] % 3 * 10) // 20 == k]), df_f([f for f in frames if (f[0] + f[0] % 4 * 20) // 70 == k])) for k in range(5)]
    whole, rows = str(tmp_path / "pairs"), str(tmp_path / "rows")
    for k, batch in enumerate(epochs):
        for _ in range(2 if k == 2 else 1):
            joined.pass_frames_writer(whole, ["pass_id", "frame_id"], 30.0, 60.0)(batch, k)
            joined.accepted_writer(rows, 60.0)(batch, k)
    want = sorted((r.epoch, r.pass_id, r.frame_id) for r in spark.read.parquet(f"{whole}/rows").collect())
    got = sorted((r.epoch, r.pass_id, r.frame_id) for r in joined.accepted_pairs(spark, rows, epochs[0].schema, 30.0).collect())
    every = sensors.frames_in_pass(df_p(passes), df_f(frames), 30.0).count()
    assert got == want and len({e for e, _, _ in got}) == 5 and 200 < len(got) < every


def test_the_pass_and_frame_stream_stores_no_pairs(spark, tmp_path, monkeypatch):
    """A crowded hour: 100 passes of up to 500 frames each are 45,050 pairs out of 600 rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from gatewise.plans import catalog, streams  # noqa: F401
    from gatewise.plans.registry import QUERIES

    n = range(500)
    rows = {"event_id": n, "ts": [datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(seconds=i) for i in n], "user_id": [4] * 500,
            "event_type": ["view" if i < 100 else "click" for i in n], "value": [1.0] * 500, "props": [""] * 500}
    (tmp_path / "in").mkdir()
    pq.write_table(pa.table({c: list(v) for c, v in rows.items()}), tmp_path / "in/events.parquet")
    monkeypatch.setattr(streams, "scratch_path", lambda _, name: str(tmp_path / name))
    found = QUERIES["st7_pass_frames_stream"](spark, str(tmp_path / "in"))
    stored = sum(pq.read_metadata(p).num_rows for p in (tmp_path / "pass-frames").rglob("*.parquet"))
    assert found.count() == 45_050 and stored <= 1_300  # the rows, held or not, and the marks


def _strips(spark, path, epochs, replay=None, **given):
    from gatewise.streaming import strips

    schema = "pass_id long, seq long, ts timestamp_ntz, frame_rows int, dx double, dy double"
    write = strips.strips_writer(path, **given)
    for k, rows in enumerate(epochs):
        for _ in range(2 if k == replay else 1):
            write(spark.createDataFrame(rows, schema), k)
    for _ in range(2 if replay is not None else 1):
        write(spark.createDataFrame([], schema), len(epochs), last=True)
    df = spark.createDataFrame([r for rows in epochs for r in rows], schema)
    return df, sorted(map(tuple, strips.written_strips(spark, path, df.schema["pass_id"]).collect()), key=repr)


def test_strips_of_an_epoch_are_folded_as_a_batch(spark, tmp_path):
    """The epochs give the batch form's strips, reordered within the delay, replayed, with null passes, motions and times."""
    from gatewise.operators import motion

    second = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rng = random.Random(3)
    frames = [(rng.choice([1, 2, 3, None]), i, second(i * 1.0), rng.choice([100, 1216]), rng.choice([0.0, 1.0, 1.0, None]),
               rng.choice([30.0, -3.0, 75.5, 0.25, None, float("nan")])) for i in range(400)]
    last = [(1, 400, None, 100, 1.0, 40.0), (2, 401, None, 100, 1.0, 40.0)]  # without a time: after all others
    epochs = [[f for f in frames if (f[1] + f[1] % 4 * 20) // 115 == k] + (last if k == 0 else []) for k in range(4)]
    assert sum(map(len, epochs)) == 402
    df, got = _strips(spark, str(tmp_path / "s"), epochs, replay=2, delay_s=100.0)
    want = sorted(map(tuple, motion.strip_plan(df).collect()), key=repr)
    assert got == want and {400, 401} <= {r[1] for r in got} and any(r[0] is None for r in got)
    assert {f.name for f in (tmp_path / "s/marks").iterdir()} == {"v3", "v4"}


def test_late_frames_are_dropped_and_silent_passes_end(spark, tmp_path):
    """A frame at the watermark is late; a pass silent for the idle time starts over, one that still waits does not."""
    second = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    frame = lambda p, i, s, dy=30.0: (p, i, second(s), 1216, 0.0, dy)
    epochs = [[frame(1, 0, 0), frame(1, 1, 1), frame(2, 2, 0)], [frame(3, 3, 700), frame(2, 4, 695)],
              [frame(3, 5, 690), frame(3, 6, 691, 50.0), frame(1, 7, 701), frame(1, 8, 702, 25.0), frame(2, 9, 703)]]
    _, got = _strips(spark, str(tmp_path / "s"), epochs, delay_s=10.0, idle_s=600.0)
    assert [r for r in got if r[0] == 1] == [(1, 1, 30, True), (1, 8, 25, True)]  # the frame at 701 s is a reference again
    assert [r for r in got if r[0] == 2] == [(2, 4, 30, True), (2, 9, 30, True)]  # its frame at 695 s waited
    assert [r for r in got if r[0] == 3] == [(3, 3, 30, True)]  # 691 s is its reference, 690 s late


def test_the_strip_stream_equals_its_sql_on_rows_with_nulls(spark, tmp_path):
    """Frames without a time come at the end of their pass, frames without a pass make no strip."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from gatewise.plans import catalog  # noqa: F401
    from gatewise.plans.registry import ORACLES, QUERIES

    rng, n = random.Random(4), range(600)
    some = lambda value, of: None if rng.randrange(of) == 0 else value
    pq.write_table(pa.table({
        "event_id": pa.array(n, pa.int64()), "ts": pa.array([some(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(700)), 9) for _ in n], pa.timestamp("us")),
        "user_id": pa.array([some(rng.randrange(6), 12) for _ in n], pa.int64()), "event_type": ["view"] * 600,
        "value": [some(rng.uniform(0, 130), 8) for _ in n], "props": [""] * 600}), tmp_path / "events.parquet")
    found = QUERIES["st9_strip_plan_stream"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES["st9_strip_plan_stream"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 200


def test_the_strip_stream_asks_no_state_store(spark, monkeypatch):
    from gatewise.plans import catalog  # noqa: F401
    from gatewise.plans.registry import QUERIES
    from gatewise.streaming import processors

    monkeypatch.setattr(processors.OrderedFold, "__init__", None)
    found = QUERIES["st9_strip_plan_stream"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["pass_id", "seq", "rows", "at_top"] and found.count() == QUERIES["w6_strip_plan"](spark, "/root/testdata/sf0.001").count()


def test_levels_of_an_hour_are_folded_together(spark, messages, tmp_path, monkeypatch):
    """The stream's vectors are the batch form's, over batches that overlap, with no step of Python for a row."""
    from gatewise.streaming import processors

    monkeypatch.setattr(processors.OrderedFold, "__init__", None)
    path = str(tmp_path / "m")
    spill(messages, path)
    stream = stream_of(spark, messages, path)
    got = runtime.run_to_end(spark, lambda ends: jobs.loop_state_stream(stream, delay="10 minutes", ends=ends), "levels", 600.0)
    text = F.array_join(F.transform("loops", lambda v: F.when(v, "1").otherwise("0")), "")
    want = sensors.loop_state(messages).select("lane", "seq", text.alias("vector"))
    rows = lambda df: sorted(map(tuple, df.select("lane", "seq", "vector").collect()))
    assert rows(got) == rows(want) and len({r[2] for r in rows(want)}) == 4
