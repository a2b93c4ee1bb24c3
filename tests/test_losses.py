"""No operator loses or cuts rows: long texts, null keys, equal rows, crowded images, equal instants."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.operators import decoding, evidence, grammar, motion, ordered, sensors
from gatewise.sources import readers, writers
from gatewise.streaming import jobs, runtime


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_long_texts_stay_whole(spark):
    text = "XZ12" + "A1" * 39
    reads = spark.createDataFrame([(text,)], "plate_text string")
    assert {len(r[0]) for r in grammar.expand_candidates(reads).filter("gen < 100").select("cand_text").collect()} >= {len(text)}
    fixed = grammar.state_prefix_fixes(reads).select("fixed_text").collect()
    assert all(len(r[0]) == len(text) for r in fixed)


def test_null_keys_and_order_values_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, None), (1, 5000)], "pass_id long, seq long")
    assert motion.consecutive_pairs(df).count() == 5
    got = {(r.pass_id, r.seq): r.prev_seq for r in motion.consecutive_pairs(df).collect()}
    assert got[(None, 2)] == 1 and got[(1, 5000)] == 1


@pytest.mark.parametrize("seconds", [3.0, 40.0, 1e6])
def test_islands_equal_global_windows(spark, seconds):
    df = spark.range(600).select(
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("lane"), (F.col("id") % 3).cast("string"))).alias("lane"),
        F.timestamp_micros(((F.col("id") * 7919) % 601 * 400_000).cast("long")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"),
        (F.floor(F.col("id") / 5) % 4).alias("v"))
    changed = lambda before, row: ~before["v"].eqNullSafe(row["v"])
    got = ordered.islands(df, ["lane"], ordered.time_chunk(F.col("ts"), seconds), ["ts", "seq"], changed, ["v"], following="ts")
    w = W.partitionBy("lane").orderBy("ts", "seq")
    start = F.when(F.lag("seq").over(w).isNull() | ~F.lag("v").over(w).eqNullSafe(F.col("v")), F.struct("ts", "seq"))
    want = df.withColumn("_s", start).select("lane", "ts", "seq", "v", F.last("_s", True).over(w).alias("island"), F.lead("ts").over(w).alias("next_ts"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("build", [
    lambda s: decoding.ctc_runs(s.select(F.col("seq").alias("read_id"), F.col("v").alias("t"), F.col("v").alias("class_idx"), F.lit(0.5).alias("prob"))),
    lambda s: sensors.debounced_entries(s.select("lane", "ts", "seq", F.array(F.col("v") > 1).alias("loops"))),
    lambda s: sensors.liveness(s, ["lane"], 8.0),
    lambda s: sensors.barrier_intervals(s.select(F.col("lane").alias("lane_name"), F.col("ts").alias("timestamp"), F.col("seq").alias("id"), F.lit(0).alias("admission"))),
])
def test_ordered_operators_scan_twice_at_most(spark, tmp_path, build):
    spark.range(10).select(F.lit("a").alias("lane"), F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"), F.col("id").alias("v")).write.parquet(str(tmp_path / "t"))
    plan = build(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2


def test_bank_blocks_change_nothing(spark):
    draw = [[float((i * 37 + d * 11) % 17) for d in range(8)] for i in range(40)]
    patches = spark.createDataFrame([(1, draw[3]), (1, draw[3]), (2, draw[9]), (3, [0.5] * 8)], "image_id long, feat array<double>")
    bank = spark.createDataFrame([(v,) for v in draw[5:] + [draw[5]] * 60], "feat array<double>")
    whole = evidence.nearest_bank_distance(patches, bank)
    cut = evidence.nearest_bank_distance(patches, bank, block_bytes=8 * 8 * 10)
    assert whole.count() == 4 and rows(cut) == rows(whole)


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.2, 0.45])
def test_crowded_images_follow_the_same_rule(spark, threshold):
    boxes = spark.range(120).select(
        F.lit(1).alias("image_id"), F.col("id").alias("box_id"), ((F.col("id") * 13) % 60).cast("int").alias("x"), ((F.col("id") * 29) % 50).cast("int").alias("y"),
        (3 + (F.col("id") * 7) % 40).cast("int").alias("w"), (3 + (F.col("id") * 5) % 30).cast("int").alias("h"), F.lit(0).alias("class_id"),
        ((F.col("id") * 31) % 97 / 97).alias("conf"))
    assert rows(evidence.suppress_boxes(boxes, threshold, fold_limit=10)) == rows(evidence.suppress_boxes(boxes, threshold))


@pytest.mark.parametrize("threshold", [0.3, 0.25])
@pytest.mark.parametrize("across", [True, False])
def test_crowded_images_reach_partners_two_cells_away(spark, threshold, across):
    pair = [(60, 7, 103, 20), (132, 7, 31, 20)]  # overlap 31 / 103 = 0.301, classes 6 and 4
    far = [(1000 + 200 * i, 5000, 10, 10) for i in range(10)]
    data = [(1, i, *(b if across else (b[1], b[0], b[3], b[2])), 1.0 - i / 100) for i, b in enumerate(pair + far)]
    boxes = spark.createDataFrame(data, "image_id long, box_id long, x int, y int, w int, h int, conf double")
    crowded, small = (rows(evidence.suppress_boxes(boxes, threshold, fold_limit=n)) for n in (10, 100))
    assert crowded == small and {r[1] for r in small} == {0, *range(2, 12)}


def _events(spark, data):
    return spark.createDataFrame(data, "id long, t string, lane_name string").select("id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "lane_name")


def test_passes_of_one_instant_are_all_stored(spark, tmp_path):
    batch = _events(spark, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:00", "a"), (3, None, "a"), (4, "2024-01-02 00:00:00", None)])
    write = writers.append_batch_once(spark, str(tmp_path / "s"))
    for _ in range(2):  # replayed
        write(batch, 0)
    assert sorted(r.id for r in readers.read_scan_events(spark, str(tmp_path / "s")).collect()) == [1, 2, 3, 4]


def test_events_without_a_day_can_be_deleted(spark, tmp_path):
    path = str(tmp_path / "s")
    writers.append_scan_events(_events(spark, [(1, None, "a"), (2, None, "a"), (3, "2024-01-01 00:00:00", "a")]), path)
    writers.delete_scan_events(spark, path, spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.id for r in readers.read_scan_events(spark, path).collect()) == [2, 3]
    writers.delete_scan_events(spark, path, spark.createDataFrame([(2,), (3,)], "id long"))
    assert readers.read_scan_events(spark, path).count() == 0


def test_recording_ends_at_the_limit_in_both_forms(spark, tmp_path):
    passes = _events(spark, [(1, "2024-01-01 00:00:00", "a")]).select(
        F.col("id").alias("pass_id"), F.col("lane_name").alias("lane"), F.col("timestamp").alias("entry_ts"), (F.col("timestamp") + F.expr("INTERVAL 90 SECOND")).alias("exit_clear_ts"))
    frames = spark.range(12).select(F.col("id").alias("frame_id"), F.lit("a").alias("lane"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 10)).alias("ts"))
    batch = sorted(r.frame_id for r in sensors.frames_in_pass(passes, frames, 30.0).collect())
    for name, df in (("p", passes), ("f", frames)):
        df.write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    stream = jobs.pass_frames_stream(read("p", passes), read("f", frames), 30.0, delay="1 hour")
    assert batch == sorted(r.frame_id for r in runtime.run_available(stream.select("frame_id"), "frames").collect()) == [0, 1, 2, 3]


def test_a_beat_at_the_timeout_opens_an_interval(spark, tmp_path):
    beats = _events(spark, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:08", "a"), (3, "2024-01-01 00:00:15.999999", "a"), (4, "2024-01-02 00:00:00", "b")]).select(
        F.col("lane_name").alias("lane"), F.col("timestamp").alias("ts"), F.col("id").alias("seq"))
    batch = rows(sensors.liveness(beats.filter("lane = 'a'"), ["lane"], 8.0))
    beats.write.parquet(str(tmp_path / "b"))
    stream = jobs.liveness_stream(spark.readStream.schema(beats.schema).parquet(str(tmp_path / "b")), ["lane"], 8.0)
    assert rows(runtime.run_available(stream, "beats").filter("lane = 'a'")) == batch
    assert [r[3] for r in batch] == [1, 2]


def test_strip_state_goes_when_a_pass_is_silent(spark, tmp_path):
    """After the idle time the same key starts over, its first frame a reference again."""
    frame = "pass_id long, seq long, t string, frame_rows int, dx double, dy double"
    parts = [[(1, 0, "2024-01-01 00:00:00", 100, 0.0, 0.0), (1, 1, "2024-01-01 00:00:01", 100, 0.0, 30.0)],
             [(2, 0, "2024-01-01 01:00:00", 100, 0.0, 0.0)], [(2, 1, "2024-01-01 02:00:00", 100, 0.0, 0.0)],
             [(1, 2, "2024-01-01 02:00:01", 100, 0.0, 30.0), (1, 3, "2024-01-01 02:00:02", 100, 0.0, 25.0)], [(3, 0, "2024-01-01 05:00:00", 100, 0.0, 0.0)]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, frame).select("pass_id", "seq", F.col("t").cast("timestamp_ntz").alias("ts"), "frame_rows", "dx", "dy")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = runtime.run_available(jobs.strip_plan_stream(stream, idle_s=600.0), "idle").filter("pass_id = 1")
    assert sorted((r.seq, r.rows) for r in out.collect()) == [(1, 30), (3, 25)]


def test_submitted_settings_stay_in_force(tmp_path):
    code = ("from gatewise.session import build_session, shared_dir; s = build_session(); c = s.sparkContext.getConf(); "
            "print('GOT', shared_dir(s), s.conf.get('spark.sql.shuffle.partitions'), c.get('spark.driver.memory'), c.get('spark.master'))")
    args = f"--master local[1] --driver-memory 700m --conf spark.checkpoint.dir={tmp_path}/shared --conf spark.sql.shuffle.partitions=999 pyspark-shell"
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYSPARK_SUBMIT_ARGS": args, "PYTHONPATH": home}, capture_output=True, text=True, timeout=120)
    assert f"GOT {tmp_path}/shared 999 700m local[1]" in out.stdout, out.stderr[-1500:]
    assert not (tmp_path / "shared/gatewise").exists()


@pytest.fixture(scope="module")
def loops(spark):
    """Lanes of two and of three loops."""
    import random

    draw, at, data = random.Random(2), 0.0, []
    for i in range(900):
        at += draw.choice([0.02, 0.1, 0.5, 2.0, 9.0])
        kind = draw.choice(["state"] * 8 + ["heartbeat", "disconnect"])
        levels = [draw.random() < p for p in (0.6, 0.6, 0.5)] if kind == "state" else None
        data.append((draw.choice(["two", "three"]), at, i, kind, levels))
    df = spark.createDataFrame(data, "lane string, at double, seq long, kind string, loops array<boolean>")
    return df.select("lane", F.timestamp_micros((F.col("at") * 1e6).cast("long")).cast("timestamp_ntz").alias("ts"), "seq", "kind", "loops")


def test_lanes_have_their_own_settings(spark, loops):
    lanes = spark.createDataFrame([("two", 2, 0.05, None), ("three", 3, 0.3, 12.0), ("idle", 2, 9.0, None)], "lane string, n_loops int, debounce_s double, max_s double")
    got = sensors.detect_passes(loops, lanes=lanes, chunk_s=100.0)
    two = sensors.detect_passes(loops.filter("lane = 'two'"), n_loops=2, debounce_s=0.05)
    three = sensors.detect_passes(loops.filter("lane = 'three'"), n_loops=3, debounce_s=0.3, max_s=12.0)
    assert rows(got) == rows(two.unionByName(three)) and two.count() and three.count()
    # Two of three loops reached: the outcome goes by the loop times.
    part = [r for r in three.collect() if r.n_loop_times == 2 and not r.frame_cap_hit]
    assert part and all(r.outcome == "exit_never_cleared" and r.exit_engage_ts is None for r in part)


def test_the_frame_cap_ends_a_pass_in_both_forms(spark, loops, tmp_path):
    frames = loops.select("lane", (F.col("ts") + F.expr("INTERVAL 0.01 SECOND")).alias("ts"), F.col("seq").alias("frame_id"))
    lanes = spark.createDataFrame([("two", 2, 3), ("three", 3, None)], "lane string, n_loops int, max_frames int")
    batch = sensors.detect_passes(loops, frames, lanes=lanes)
    assert batch.filter("frame_cap_hit AND lane = 'two'").count() > 5
    end = loops.agg(F.max("ts").alias("ts")).select(F.explode(F.array(F.lit("two"), F.lit("three"))).alias("lane"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
                                                   F.lit(10_000).cast("long").alias("seq"), F.lit("heartbeat").alias("kind"), F.lit(None).cast("array<boolean>").alias("loops"))
    closed = loops.unionByName(end)
    for name, df in (("s", closed), ("f", frames.unionByName(end.select("lane", "ts", F.col("seq").alias("frame_id"))))):
        df.repartition(2).write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    stream = jobs.detect_passes_stream(read("s", closed), delay="10 seconds", frames=read("f", frames), lanes=lanes)
    want = sensors.detect_passes(closed, frames, lanes=lanes)
    got = runtime.run_available(stream, "caps")
    assert rows(got.select(want.columns)) == rows(want)


def test_long_texts_meet_on_segments(spark):
    """Against every pair, with lengths around the limit where both kinds of keys are made."""
    import random

    from gatewise.operators import joins

    draw = random.Random(4)
    texts = set()
    for size in (6, 29, 30, 31, 32, 33, 34, 35, 36, 60, 300):
        base = "".join(draw.choice("ABC123") for _ in range(size))
        texts.add(base)
        for _ in range(12):
            t = list(base)
            for _ in range(draw.randint(1, 3)):
                at = draw.randrange(len(t))
                t[at:at + draw.randint(0, 1)] = draw.choice(["", "X", "Y"])
            texts.add("".join(t))
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "plate_text string")
    got = {(r.left_text, r.right_text) for r in joins.similar_plates(df, df).collect()}
    a, b = df.withColumnRenamed("plate_text", "a"), df.withColumnRenamed("plate_text", "b")
    from gatewise.functions import plates as P

    want = {tuple(r) for r in a.join(b, P.similar(F.col("a"), F.col("b"))).collect()}
    assert got == want and len(want) > len(texts)


def test_best_frame_of_a_pass_without_pairs(spark):
    """The same frame as over all pairs, for passes of any length, ties, hidden scores and cells' borders."""
    import random

    rng, at = random.Random(5), lambda us: f"2024-01-01 00:{us // 60_000_000:02d}:{us // 1_000_000 % 60:02d}.{us % 1_000_000:06d}"
    frames = [(i, rng.choice("ab"), at(rng.randrange(0, 240_000_000, 250)), rng.choice([0.5, 1.0, 2.0, None])) for i in range(600)]
    passes = []
    for i in range(300):
        a = rng.choice([0, 30_000_000, 60_000_000, rng.randrange(200_000_000), rng.randrange(0, 200_000_000, 250)])
        z = rng.choice([None, a, a + 250, a + 5_000, a + rng.randrange(30_000_000), a + 90_000_000, a - 1])
        passes.append((i, rng.choice("ab"), at(a), None if z is None or z < 0 else at(z)))
    passes += [(900, None, at(0), None), (901, "a", None, at(5)), (902, "zz", at(0), None)]
    p = spark.createDataFrame(passes, "pass_id long, lane string, e string, c string").select(
        "pass_id", "lane", F.col("e").cast("timestamp_ntz").alias("entry_ts"), F.col("c").cast("timestamp_ntz").alias("exit_clear_ts"))
    f = spark.createDataFrame(frames, "frame_id long, lane string, t string, score double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    pairs = sensors.frames_in_pass(p, f, 30.0).groupBy("pass_id").agg(F.max(F.struct("score", "frame_id")).alias("v")).select("pass_id", "v.frame_id")
    got = sensors.best_frame_in_pass(p, f, 30.0).select("pass_id", "frame_id")
    want = sorted(map(tuple, pairs.collect()))
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    assert sensors.best_frame_in_pass(p.limit(0), f, 30.0).count() == 0
