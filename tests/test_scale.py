"""Properties that must hold however rows are split, and plans that must not change."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.functions import machines as M
from gatewise.functions import plates as P
from gatewise.operators import evidence, grammar, joins, motion, ordered, registry, reports, sensors, voting
from gatewise.plans import sensing
from gatewise.plans.reporting import decided_events


def rows(df):
    return sorted(df.collect(), key=repr)


@pytest.fixture(scope="module")
def hot_lane(spark):
    """One lane holds most rows."""
    rng = random.Random(7)
    data = [(("hot" if rng.random() < 0.7 else f"l{rng.randrange(5)}"), i, i * 3 + rng.randrange(3),
             rng.choice([None, *range(9)])) for i in range(900)]
    return spark.createDataFrame(data, "lane string, seq long, at long, v int").withColumn(
        "ts", F.timestamp_seconds("at").cast("timestamp_ntz"))


@pytest.mark.parametrize("seconds", [7.0, 100.0, 1e6])
def test_chunked_windows_equal_global_windows(hot_lane, seconds):
    got = ordered.running(hot_lane, ["lane"], ordered.time_chunk(F.col("ts"), seconds), ["ts", "seq"], s=("sum", "v"),
                          m=("max", "v"), b=("max_before", "v"), l=("last", "v"), g=("lag", "v"), d=("lead", "v"))
    w = W.partitionBy("lane").orderBy("ts", "seq")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = hot_lane.select(
        "*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"), F.max("v").over(before).alias("b"),
        F.last("v", True).over(upto).alias("l"), F.lag("v").over(w).alias("g"), F.lead("v").over(w).alias("d"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("chunk_s", [3600.0, 20_000.0, 86_400.0])
def test_passes_do_not_depend_on_chunks(tables, chunk_s):
    states = sensing.states(tables)
    whole = sensors.detect_passes(states, debounce_s=60.0, max_s=3600.0, chunk_s=1e9)
    cut = sensors.detect_passes(states, debounce_s=60.0, max_s=3600.0, chunk_s=chunk_s)
    assert rows(cut.drop("_chunk")) == rows(whole.drop("_chunk"))


@pytest.mark.parametrize("cut", [1, 5, 17])
def test_strips_of_the_stream_equal_the_batch(tables, cut):
    numbered = sensing.numbered_motion(tables)
    want = rows(motion.strip_plan(numbered))
    got = []
    by_pass = {}
    for r in numbered.orderBy("pass_id", "seq").collect():
        moved = r.dy if r.dx is not None else None
        by_pass.setdefault(r.pass_id, []).append({"seq": r.seq, "frame_rows": r.frame_rows, "dy": moved})
    for pass_id, frames in by_pass.items():
        state = None
        for at in range(0, len(frames), cut):
            strips, state = M.fold_strips(state, frames[at:at + cut], {"direction": 0})
            got += [(pass_id, s["seq"], s["rows"], s["at_top"]) for s in strips]
    assert sorted(got) == sorted(tuple(r) for r in want)


def test_strips_never_exceed_movement(tables):
    numbered = sensing.numbered_motion(tables)
    total = motion.strip_plan(numbered).groupBy("pass_id").agg(F.sum("rows").alias("rows"))
    moved = motion.motion_stats(numbered).select("pass_id", "total_abs_dy")
    assert total.join(moved, "pass_id").filter("rows > total_abs_dy").count() == 0


def test_backward_spike_is_capped():
    steps = [{"seq": i, "frame_rows": 1000, "dy": d} for i, d in enumerate([0.0, 30.0, -5000.0, 20.0, 20.0, 20.0])]
    out, state = M.fold_strips(None, steps, {"direction": 0})
    assert [(s["seq"], s["rows"]) for s in out] == [(1, 30), (5, 12)] and state["go"] == 1


CFG = {"n_loops": 2, "debounce_us": 50, "max_us": 1000, "max_frames": 3}


def lane(*events, cfg=CFG):
    parsed = [{"ts": t, "seq": i, "kind": k, "loops": v} for i, (t, k, v) in enumerate(events)]
    return M.advance_lane(None, parsed, cfg)


def test_entry_blip_is_ignored():
    out, state = lane((0, M.STATE, [True, False]), (49, M.STATE, [False, False]), (5000, M.CLOCK, None))
    assert out == [] and state["times"] == []


def test_pass_completes_and_rearms():
    out, state = lane((0, M.STATE, [True, False]), (100, M.STATE, [True, True]), (200, M.STATE, [True, False]), (300, M.CLOCK, None))
    assert [(p["entry"], p["engage"], p["clear"]) for p in out] == [(50, 100, 200)]
    assert state["times"] == [250]  # the entry loop is still engaged


def test_faults_by_progress():
    never, _ = lane((0, M.STATE, [True, False]), (60, M.STATE, [False, False]), (5000, M.CLOCK, None))
    stuck, _ = lane((0, M.STATE, [True, False]), (60, M.STATE, [False, True]), (5000, M.CLOCK, None))
    assert [(p["engage"], p["clear"], p["ended"]) for p in never] == [(None, None, 1050)]
    assert [(p["engage"], p["clear"]) for p in stuck] == [(60, None)]


def test_frame_cap_and_disconnect():
    frames = [(100 + i, M.FRAME, None) for i in range(3)]
    capped, _ = lane((0, M.STATE, [True, False]), *frames)
    assert [p["frame_cap_hit"] for p in capped] == [True]
    lost, state = lane((0, M.STATE, [True, False]), (100, M.DISCONNECT, None), (5000, M.CLOCK, None))
    assert [p["engage"] for p in lost] == [None] and state["levels"] == [False, False]


def overlap(a, b):
    iw = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    ih = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    inter = iw * ih if iw > 0 and ih > 0 else 0
    union = a[4] * a[5] + b[4] * b[5] - inter
    return inter / union if union > 0 else 0.0


@pytest.mark.parametrize("fold_limit", [8400, 3])
def test_suppression_equals_brute_force(spark, fold_limit):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), i, rng.randrange(60), rng.randrange(60), rng.randrange(0, 50),
             rng.randrange(1, 50), rng.randrange(40) / 40) for i in range(260)]
    want = set()
    for image, group in itertools.groupby(sorted(data, key=lambda r: (r[0], -r[6], r[1])), key=lambda r: r[0]):
        kept = []
        for b in group:
            if all(overlap(k, b) <= 0.45 for k in kept):
                kept.append(b)
        want |= {(image, b[1]) for b in kept}
    df = spark.createDataFrame(data, "image_id int, box_id int, x int, y int, w int, h int, conf double")
    got = {(r.image_id, r.box_id) for r in evidence.suppress_boxes(df, fold_limit=fold_limit).collect()}
    assert got == want


@pytest.mark.parametrize("block_bytes", [64 << 20, 2000])
def test_blocked_distance_equals_naive(spark, block_bytes):
    rng = np.random.default_rng(1)
    p, b = rng.normal(size=(40, 8)), rng.normal(size=(70, 8))
    patches = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(p)], "image_id int, cell int, feat array<double>")
    bank = spark.createDataFrame([(v.tolist(),) for v in b], "feat array<double>")
    got = {r.cell: r.distance for r in evidence.nearest_bank_distance(patches, bank, block_bytes).collect()}
    want = np.sqrt(((p[:, None, :] - b[None]) ** 2).sum(-1)).min(1)
    assert len(got) == 40 and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_sample_is_fixed_and_bounded(spark):
    df = spark.range(1000).select(F.col("id").alias("image_id"), F.lit(0).alias("cell"), F.array(F.lit(1.0)).alias("feat"))
    one = rows(evidence.sample_bank(df, 50).select("image_id"))
    two = rows(evidence.sample_bank(df.repartition(17), 50).select("image_id"))
    assert len(one) == 50 and one == two
    assert evidence.sample_bank(df, 5000).count() == 1000


@pytest.mark.parametrize("cells,found", [
    ([(0, 0, 5.0)], []),
    ([(0, 0, 5.0), (1, 1, 6.0)], [(0, 0, 2, 2, 6.0)]),
    ([(0, 0, 1.0), (0, 1, 2.0), (3, 3, 9.0), (3, 4, 8.0)], [(0, 0, 2, 1, 2.0), (3, 3, 2, 1, 9.0)]),
    # A pair inside a ring's hole is not outermost.
    ([(y, x, 1.0) for y in range(6) for x in range(6) if y in (0, 5) or x in (0, 5)] + [(2, 2, 7.0), (2, 3, 7.0)], [(0, 0, 6, 6, 7.0)]),
])
def test_regions(cells, found):
    assert sorted(evidence.find_regions(cells)) == found


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["DL5CY3199", "HR26FT2618", "KA01AB12", "AB1", "ABCDEFG", ""]
    def noisy(t):
        t = list(t)
        for _ in range(rng.randrange(4)):
            op, i = rng.randrange(3), rng.randrange(len(t) + 1)
            if op == 0: t.insert(i, rng.choice("AB01"))
            elif t and op == 1: t.pop(min(i, len(t) - 1))
            elif t: t[min(i, len(t) - 1)] = rng.choice("AB01")
        return "".join(t)
    left, right = ([noisy(rng.choice(base)) for _ in range(80)] for _ in range(2))
    mk = lambda ts: spark.createDataFrame([(t,) for t in ts], "plate_text string")
    got = {(r.left_text, r.right_text): (r.n_left, r.n_right) for r in joins.similar_plates(mk(left), mk(right)).collect()}
    texts = spark.createDataFrame([(a, b) for a in set(left) for b in set(right)], "a string, b string")
    near = texts.filter("a <> '' AND b <> '' AND abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= "
                        "CASE WHEN greatest(length(a), length(b)) <= 7 THEN 1 ELSE 2 END").collect()
    assert got == {(r.a, r.b): (left.count(r.a), right.count(r.b)) for r in near}


def test_similar_pairs_meet_once_without_moving_pairs(spark):
    """Texts of few characters share many keys; each pair comes once, from a join on keys that nothing follows."""
    rng = random.Random(6)
    texts = ["".join(t) for n in (1, 2, 3, 7, 8) for t in itertools.product("AB", repeat=n)]
    for n in (9, 10, 11, 31, 32, 33, 34, 35, 36, 37):
        for _ in range(12):
            base = [rng.choice("AB") for _ in range(n)]
            noisy = [base[:], ["AB"[c == "A"] for c in base], base[1:] + base[:1], base[2:], base[:3] + ["1"] + base[3:], base[:-1] + ["0", "0"]]
            noisy[0][rng.randrange(n)] = "2"
            texts += map("".join, [base, *noisy])
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "plate_text string")
    pairs = joins.similar_plates(df, df)
    got = sorted((r.left_text, r.right_text, r.distance) for r in pairs.collect())
    a, b = df.withColumnRenamed("plate_text", "a"), df.withColumnRenamed("plate_text", "b")
    near = a.join(b, P.similar(F.col("a"), F.col("b"))).select("a", "b", F.levenshtein("a", "b"))
    assert got == sorted(tuple(r) for r in near.collect()) and len(got) > 5_000
    above, join, _ = plan(pairs).split("== Initial Plan ==")[-1].partition("SortMergeJoin")
    assert join and "Exchange" not in above and "Aggregate" not in above


# Plans -------------------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_events_is_top_k(tables):
    assert "TakeOrderedAndProject" in plan(reports.recent_events(tables.view("scan_events")))


def test_history_filter_reaches_the_scan(tables, spark, tmp_path):
    from gatewise.sources import readers, writers

    writers.append_scan_events(tables.view("scan_events"), str(tmp_path / "e"))
    stored = readers.read_scan_events(spark, str(tmp_path / "e"))
    text = plan(reports.history_search(stored, start="2024-01-05", end="2024-01-06", limit=None).select("id"))
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in text
    kept = plan(reports.history_search(stored, start="2024-01-05", limit=500).select("id"))
    assert "PushedFilters: []" in kept  # the page's filters apply after its newest 500


def test_small_registry_is_broadcast_by_size(tables):
    matched = registry.match_registry(tables.view("scan_events"), tables.view("registry"))
    assert "BroadcastHashJoin" in plan(matched)
    spark = tables.spark
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(registry.match_registry(tables.view("scan_events"), tables.view("registry")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_frame_selection_limits_before_the_shuffle(tables):
    text = plan(voting.best_plate_frames(tables.view("plate_reads")))
    assert text.count("WindowGroupLimit") == 2


def test_plate_text_stays_in_the_jvm(tables):
    for df in (grammar.score_reads(tables.view("plate_reads")), grammar.choose_plate(tables.view("plate_reads")),
               grammar.score_candidates(tables.view("plate_reads"))):
        assert "Python" not in plan(df) and "InPandas" not in plan(df)


def test_expansion_never_shuffles(tables):
    assert "Exchange hashpartitioning" not in plan(grammar.expand_candidates(tables.view("plate_reads")))


def test_flagship_has_one_shuffle_of_events(tables):
    text = plan(reports.kpi_totals(decided_events(tables), limit=None, by="lane_name"))
    assert text.count("Exchange hashpartitioning(lane_name") == 1


def test_a_chunk_reaches_its_fold_in_batches_and_in_order(spark, hot_lane):
    """However long a chunk is, a step sees one batch of it and goes on from the state before."""
    def step(state, rows, config):
        seen = [state["last"], *(r["at"] for r in rows)]
        return [{"n": len(rows), "ordered": seen == sorted(seen)}], {"last": seen[-1]}

    output = T.ArrayType(T.StructType([T.StructField("n", T.LongType()), T.StructField("ordered", T.BooleanType())]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 32)
    try:
        out = ordered.fold_chunks(hot_lane.repartition(5), ["lane"], F.lit(0).cast("long"), F.struct("at", "seq"), step, None, {}, output,
                                  lambda config: {"last": -1}).collect()
    finally:
        spark.conf.set(key, before)
    assert max(r.n for r in out) <= 32 and all(r.ordered for r in out)
    counts = {r["lane"]: r["count"] for r in hot_lane.groupBy("lane").count().collect()}
    assert {lane: sum(r.n for r in out if r.lane == lane) for lane in counts} == counts


def test_pairs_of_passes_and_frames_are_not_left_to_the_tasks_of_a_scan(tables):
    """The pairs are many more than the rows: both sides are dealt by lane and time, however small they are."""
    found = sensors.frames_in_pass(tables.view("passes"), tables.view("frames"), 21_600.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _crowded(spark, n_passes, n_frames):
    """Passes and frames of three hours, also without lane, time or label, and with equal times."""
    at = lambda s: (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=s.cast("decimal(18,6)")))
    lane = F.when(F.col("id") % 50 != 7, F.concat(F.lit("l"), (F.col("id") % 2).cast("string")))
    entry = at(F.floor(F.col("id") * 10_800 / n_passes))
    passes = spark.range(n_passes).select(F.col("id").alias("pass_id"), lane.alias("lane"), F.when(F.col("id") % 31 != 3, entry).alias("entry_ts"),
                                          F.when(F.col("id") % 3 != 0, entry + F.make_dt_interval(secs=F.lit(2400) * (F.col("id") % 4 - 1))).alias("exit_clear_ts"))
    frames = spark.range(n_frames).select(F.col("id").alias("frame_id"), lane.alias("lane"), F.when(F.col("id") % 29 != 5, at(F.floor(F.col("id") * 10_800 / n_frames))).alias("ts"),
                                          F.when(F.col("id") % 4 != 1, F.lit("driver")).alias("label"))
    return passes, frames


def test_frames_meet_passes_in_blocks_and_no_pair_is_lost(spark):
    passes, frames = _crowded(spark, 120, 3000)
    found = sensors.frames_in_pass(passes, frames, 3600.0)
    p, f = passes.collect(), frames.collect()
    hour = datetime.timedelta(hours=1)
    want = [(a.pass_id, b.frame_id, b.lane, b.label, b.ts) for a in p for b in f if None not in (a.lane, a.entry_ts, b.ts) and a.lane == b.lane
            and a.entry_ts <= b.ts <= min(a.exit_clear_ts or a.entry_ts + hour, a.entry_ts + hour)]
    assert found.columns == ["lane", "pass_id", "entry_ts", "exit_clear_ts", "end_ts", "frame_id", "ts", "label"]
    assert sorted(map(repr, (tuple(r) for r in found.select("pass_id", "frame_id", "lane", "label", "ts").collect()))) == sorted(map(repr, want))
    assert len(want) > 30 * sensors.BLOCK


def test_written_pairs_of_a_crowded_lane_take_little_disk(spark, tmp_path):
    """Pairs come block by block, so that files of pairs repeat themselves at short distance."""
    passes, frames = _crowded(spark, 1000, 40_000)
    pairs = sensors.frames_in_pass(passes, frames, 3600.0).select("pass_id", "frame_id", "label")
    pairs.write.option("compression", "snappy").parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    size = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet"))
    assert n > 2_000_000 and size < 0.6 * n, size / n


def test_leaders_of_a_batch_equal_plain_python(spark):
    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
        return d[-1]

    alike = lambda a, b: bool(a) and bool(b) and abs(len(a) - len(b)) <= 2 and edits(a, b) <= (1 if max(len(a), len(b)) <= 7 else 2)
    rng, groups = random.Random(3), [[], [None, "", "A"]]
    for _ in range(400):
        base, group = [rng.choice("AB12") for _ in range(rng.randint(1, 12))], []
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randint(0, len(t)) : rng.randint(0, len(t))] = rng.choice(["", "A", "B2"])
            group.append("".join(t))
        groups.append(group)
    want = []
    for group in groups:
        leaders = []
        for t in group:
            if not any(alike(x, t) for x in leaders):
                leaders.append(t)
        want.append((leaders, [next((k for k, x in enumerate(leaders) if alike(x, t)), -1) for t in group]))
    assert list(zip(*voting.find_leaders(groups))) == want
    df = spark.createDataFrame([(k, [(t,) for t in g]) for k, g in enumerate(groups)], "k long, members array<struct<n:string>>")
    got = voting.with_leaders(df).orderBy("k").collect()
    assert [(r.leaders, [m.c for m in r.members]) for r in got] == want


def test_the_best_group_is_found_once_for_an_image(tables):
    found = voting.rank_candidates(voting.attempt_candidates(tables.view("plate_reads")))
    assert "lambda best" in found._jdf.queryExecution().optimizedPlan().toString()
