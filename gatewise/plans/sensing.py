"""Sensor, pass, frame and motion queries.

The derived sensor rows lie minutes apart, so durations are scaled up: debounce 60 s, pass limit and
liveness 3,600 s, pass windows of hours.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import decisions, lanes, motion, sensors, voting
from gatewise.plans.registry import query
from gatewise.plans.reporting import DECIDED_SQL, decided_events
from gatewise.plans.tables import with_views

DEBOUNCE_S, MAX_PASS_S, ALIVE_S, OPEN_S, PASS_WINDOW_S = 60.0, 3600.0, 3600.0, 3600.0, 21_600.0


def messages(df):
    """Derived loop states as parsed messages."""
    return df.select(
        "lane", "ts", "seq", F.when(F.col("heartbeat"), F.lit("heartbeat")).otherwise(F.lit("state")).alias("kind"),
        F.when(~F.col("heartbeat"), F.array("loop0", "loop1")).alias("loops"))


def states(t):
    return messages(t.view("loop_states"))


def vector(c):
    """Loop vector as text, e.g. ``10``."""
    return F.array_join(F.transform(c, lambda b: F.when(b, F.lit("1")).when(~b, F.lit("0")).otherwise(F.lit("_"))), "")


_PARSED_SQL = r"""
tok AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS tr, list_filter(string_split(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' '),
  lambda x: x <> '') AS w FROM v_loop_lines),
parsed AS (SELECT lane, ts, seq, CASE WHEN upper(tr) = '|HLT%' THEN 'heartbeat' WHEN len(w) >= 2 AND upper(w[1]) = 'STATE' THEN 'state'
  ELSE 'reject' END AS kind, CASE WHEN w[2] IS NULL THEN NULL ELSE w[2] = '1' END AS a, CASE WHEN w[3] IS NULL THEN NULL ELSE w[3] = '1' END AS b FROM tok)"""


@query("st1_parse_loop_messages", oracle=with_views("loop_lines", body=_PARSED_SQL + """
SELECT seq, kind, CASE WHEN kind = 'state' THEN concat(CASE WHEN a THEN '1' WHEN NOT a THEN '0' ELSE '_' END,
  CASE WHEN b THEN '1' WHEN NOT b THEN '0' ELSE '_' END) END AS loops FROM parsed"""))
def _st1(t):
    return sensors.parse_loop_messages(t.view("loop_lines")).select("seq", "kind", vector("loops").alias("loops"))


@query("st2_loop_state", oracle=with_views("loop_lines", body=_PARSED_SQL + """,
m AS (SELECT lane, ts, seq, CASE WHEN seq % 50 = 7 THEN false WHEN kind = 'state' THEN a END AS a,
  CASE WHEN seq % 50 = 7 THEN false WHEN kind = 'state' THEN b END AS b FROM parsed)
SELECT seq, concat(CASE WHEN coalesce(last_value(a IGNORE NULLS) OVER w, false) THEN '1' ELSE '0' END,
  CASE WHEN coalesce(last_value(b IGNORE NULLS) OVER w, false) THEN '1' ELSE '0' END) AS loops FROM m
WINDOW w AS (PARTITION BY lane ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"""))
def _st2(t):
    parsed = sensors.parse_loop_messages(t.view("loop_lines")).withColumn(
        "kind", F.when(F.col("seq") % 50 == 7, F.lit("disconnect")).otherwise(F.col("kind")))
    return sensors.loop_state(parsed).select("seq", vector("loops").alias("loops"))


_STATE_ROWS = "s AS (SELECT * FROM v_loop_states WHERE NOT heartbeat)"


@query("w12_loop_flips", oracle=with_views("loop_states", body=_STATE_ROWS + """,
p AS (SELECT *, lag(loop0) OVER w AS p0, lag(loop1) OVER w AS p1 FROM s WINDOW w AS (PARTITION BY lane ORDER BY ts, seq))
SELECT lane, seq, loop0, loop1 FROM p WHERE loop0 IS DISTINCT FROM p0 OR loop1 IS DISTINCT FROM p1"""))
def _w12(t):
    return sensors.loop_flips(states(t).filter("kind = 'state'")).select(
        "lane", "seq", F.col("loops")[0].alias("loop0"), F.col("loops")[1].alias("loop1"))


@query("st3_debounced_entries", oracle=with_views("loop_states", body=_STATE_ROWS + """,
p AS (SELECT *, lag(loop0) OVER (PARTITION BY lane ORDER BY ts, seq) AS p0 FROM s),
f AS (SELECT * FROM p WHERE loop0 IS DISTINCT FROM p0),
r AS (SELECT *, lead(ts) OVER (PARTITION BY lane ORDER BY ts, seq) AS off_ts FROM f)
SELECT r.lane, r.ts AS engaged_ts, r.ts + INTERVAL 60 SECOND AS entry_ts FROM r
JOIN (SELECT lane, max(ts) AS newest FROM s GROUP BY lane) n ON n.lane = r.lane
WHERE loop0 AND r.ts + INTERVAL 60 SECOND <= coalesce(off_ts, newest)"""))
def _st3(t):
    return sensors.debounced_entries(states(t).filter("kind = 'state'"), DEBOUNCE_S)


_PASSES_SQL = """
ev AS (SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY ts, seq) AS k, epoch_us(ts) AS ts, heartbeat, loop0, loop1 FROM {rows}),
st AS (
  SELECT DISTINCT lane, CAST(0 AS BIGINT) AS k, false AS l0, false AS l1, CAST(NULL AS BIGINT) AS anchor, CAST(NULL AS BIGINT) AS entry,
    CAST(NULL AS BIGINT) AS engage, CAST(NULL AS BIGINT) AS o_entry, CAST(NULL AS BIGINT) AS o_engage, CAST(NULL AS BIGINT) AS o_clear,
    CAST(NULL AS BIGINT) AS o_end FROM ev
  UNION ALL
  SELECT lane, CASE act WHEN 'next' THEN k + 1 ELSE k END, CASE act WHEN 'next' THEN n0 ELSE l0 END, CASE act WHEN 'next' THEN n1 ELSE l1 END,
    CASE act WHEN 'limit' THEN CASE WHEN l0 THEN entry + {max} END WHEN 'entry' THEN NULL
      ELSE CASE WHEN entry IS NULL THEN CASE WHEN n0 THEN coalesce(anchor, ts) END
        WHEN engage IS NOT NULL AND NOT n1 THEN CASE WHEN n0 THEN ts END END END,
    CASE act WHEN 'limit' THEN NULL WHEN 'entry' THEN anchor + {deb}
      ELSE CASE WHEN engage IS NOT NULL AND NOT n1 THEN NULL ELSE entry END END,
    CASE act WHEN 'limit' THEN NULL WHEN 'entry' THEN CASE WHEN l1 THEN anchor + {deb} END
      ELSE CASE WHEN entry IS NULL OR (engage IS NOT NULL AND NOT n1) THEN NULL WHEN engage IS NOT NULL THEN engage WHEN n1 THEN ts END END,
    CASE WHEN done THEN entry END, CASE WHEN done THEN engage END, CASE WHEN done AND act = 'next' THEN ts END,
    CASE WHEN done THEN CASE act WHEN 'next' THEN ts ELSE entry + {max} END END
  FROM (
    SELECT x.*, act = 'limit' OR (act = 'next' AND entry IS NOT NULL AND engage IS NOT NULL AND NOT n1) AS done FROM (
      SELECT st.*, e.ts, CASE WHEN e.heartbeat THEN st.l0 ELSE e.loop0 END AS n0, CASE WHEN e.heartbeat THEN st.l1 ELSE e.loop1 END AS n1,
        CASE WHEN st.entry + {max} <= e.ts THEN 'limit' WHEN st.entry IS NULL AND st.anchor + {deb} <= e.ts THEN 'entry' ELSE 'next' END AS act
      FROM st JOIN ev e ON e.lane = st.lane AND e.k = st.k + 1) x) y),
passes AS (SELECT lane, make_timestamp(o_entry) AS entry_ts, make_timestamp(o_engage) AS exit_engage_ts, make_timestamp(o_clear) AS exit_clear_ts,
  make_timestamp(o_end) AS end_ts, CASE WHEN o_clear IS NOT NULL THEN 'completed' WHEN o_engage IS NOT NULL THEN 'exit_never_cleared'
  ELSE 'exit_never_engaged' END AS outcome FROM st WHERE o_entry IS NOT NULL)
"""


def passes_sql(rows="v_loop_states"):
    """Passes of the messages in ``rows``, as common table expressions."""
    return _PASSES_SQL.format(max=int(MAX_PASS_S * 1e6), deb=int(DEBOUNCE_S * 1e6), rows=rows)


@query("st4_detect_passes", oracle=with_views("loop_states", recursive=True, body=passes_sql() + "SELECT * FROM passes"))
def _st4(t):
    found = sensors.detect_passes(states(t), debounce_s=DEBOUNCE_S, max_s=MAX_PASS_S, chunk_s=5 * 86_400.0)
    return found.select("lane", "entry_ts", "exit_engage_ts", "exit_clear_ts", "end_ts", "outcome")


LIVENESS_SQL = """
b AS (SELECT *, lag(ts) OVER (PARTITION BY lane ORDER BY ts, seq) AS p FROM v_loop_states WHERE heartbeat),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY ts, seq) AS g FROM b)
SELECT lane, min(ts) AS online_from, max(ts) + INTERVAL 1 HOUR AS online_until, count(*) AS n_beats FROM i GROUP BY lane, g"""


@query("st5_liveness", oracle=with_views("loop_states", body=LIVENESS_SQL))
def _st5(t):
    return sensors.liveness(states(t).filter("kind = 'heartbeat'"), ["lane"], ALIVE_S)


@query("st6_classify_fault", oracle=with_views("passes", body="""
SELECT pass_id, CASE WHEN frame_cap_hit THEN 'frame_cap' WHEN exit_clear_ts IS NOT NULL THEN 'completed'
  WHEN exit_engage_ts IS NOT NULL THEN 'exit_never_cleared' ELSE 'exit_never_engaged' END AS outcome,
  CASE WHEN exit_clear_ts IS NOT NULL AND NOT frame_cap_hit THEN 'completed'
  WHEN exit_engage_ts IS NOT NULL THEN 'exit_never_cleared' ELSE 'exit_never_engaged' END AS folded FROM v_passes"""))
def _st6(t):
    passes = decisions.classify_fault(t.view("passes"), fold_frame_cap=True).withColumnRenamed("outcome", "folded")
    return decisions.classify_fault(passes).select("pass_id", "outcome", "folded")


@query("a14_pass_outcomes", oracle=with_views("passes", body="""
SELECT lane, CASE WHEN frame_cap_hit THEN 'frame_cap' WHEN exit_clear_ts IS NOT NULL THEN 'completed'
  WHEN exit_engage_ts IS NOT NULL THEN 'exit_never_cleared' ELSE 'exit_never_engaged' END AS outcome, count(*) AS n_passes
FROM v_passes GROUP BY ALL"""))
def _a14(t):
    return decisions.pass_outcomes(decisions.classify_fault(t.view("passes")))


@query("f8_pass_metrics", oracle=with_views("passes", "controllers", body="""
pos AS (SELECT lane_id, list_transform(list_filter(list_transform(string_split(loop_positions, ','), lambda p: trim(p)), lambda p: p <> ''),
  lambda p: CAST(p AS DOUBLE)) AS q FROM v_controllers)
SELECT pass_id, CASE WHEN exit_engage_ts > entry_ts THEN (q[-1] - q[1]) / ((epoch_us(exit_engage_ts) - epoch_us(entry_ts)) / 1e6) ELSE 0E0 END AS speed_mps,
  (epoch_us(coalesce(exit_clear_ts, exit_engage_ts, entry_ts)) - epoch_us(entry_ts)) / 1e6 AS duration_s
FROM v_passes LEFT JOIN pos ON lane_id = lane"""))
def _f8(t):
    usable = lanes.lane_positions(t.view("controllers")).filter("usable")
    return decisions.pass_metrics(t.view("passes"), usable).select("pass_id", "speed_mps", "duration_s")


@query("j3_frames_in_pass", oracle=with_views("passes", "frames", body="""
SELECT p.pass_id, f.frame_id, f.camera FROM v_passes p JOIN v_frames f ON f.lane = p.lane AND f.ts >= p.entry_ts
  AND f.ts <= coalesce(p.exit_clear_ts, p.entry_ts + INTERVAL 6 HOUR)"""))
def _j3(t):
    passes, frames = t.view("passes").select("pass_id", "lane", "entry_ts", "exit_clear_ts"), t.view("frames").select("frame_id", "lane", "ts", "camera")
    return sensors.frames_in_pass(passes, frames, PASS_WINDOW_S).select("pass_id", "frame_id", "camera")


_ENTRY_SQL = """
asked AS (SELECT p.pass_id, p.lane, c.camera, p.entry_ts FROM v_passes p, (VALUES ('driver'), ('anpr')) c(camera)),
entry AS (SELECT a.pass_id, a.lane, a.camera, f.frame_id AS entry_frame FROM asked a ASOF LEFT JOIN (SELECT lane, camera, ts, frame_id FROM v_frames) f
  ON f.lane = a.lane AND f.camera = a.camera AND f.ts <= a.entry_ts)"""


@query("j4_frame_at_entry", oracle=with_views("passes", "frames", body=_ENTRY_SQL + "\nSELECT * FROM entry"))
def _j4(t):
    return sensors.frame_at_entry(t.view("passes"), t.view("frames"))


@query("w2_best_driver_frame", oracle=with_views("passes", "frames", body=_ENTRY_SQL + """,
best AS (SELECT * FROM (SELECT p.pass_id, f.frame_id, row_number() OVER (PARTITION BY p.pass_id ORDER BY f.score DESC, f.frame_id DESC) AS r
  FROM v_passes p JOIN v_frames f ON f.lane = p.lane AND f.camera = 'driver' AND f.delivered AND f.ts >= p.entry_ts
  AND f.ts <= coalesce(p.exit_clear_ts, p.entry_ts + INTERVAL 6 HOUR)) q WHERE r = 1)
SELECT e.pass_id, coalesce(b.frame_id, e.entry_frame) AS driver_frame, b.frame_id IS NULL AS is_fallback
FROM entry e LEFT JOIN best b ON b.pass_id = e.pass_id WHERE e.camera = 'driver'"""))
def _w2(t):
    passes, frames = t.view("passes"), t.view("frames").filter("camera = 'driver'")
    inside = sensors.best_frame_in_pass(passes, frames.filter("delivered"), PASS_WINDOW_S)
    entry = sensors.frame_at_entry(passes, frames, ("driver",))
    return voting.best_driver_frame(inside, entry)


@query("st8_throttle_latest", oracle=with_views("frames", body="""
SELECT lane, frame_id, camera FROM (SELECT *, row_number() OVER (PARTITION BY lane, epoch_us(ts) // 3600000000 ORDER BY ts DESC, frame_id DESC) AS r
FROM v_frames) q WHERE r = 1"""))
def _st8(t):
    return sensors.throttle_latest(t.view("frames"), 3600.0).select("lane", "frame_id", "camera")


@query("st12_camera_health", oracle=with_views("frames", body="""
h AS (SELECT lane, camera, max(ts) FILTER (delivered) AS last_frame_ts, max(ts) FILTER (NOT delivered) AS last_error_ts,
  arg_max(concat('timeout ', frame_id), ts) FILTER (NOT delivered) AS txt FROM v_frames GROUP BY lane, camera)
SELECT lane, camera, last_frame_ts, last_error_ts, CASE WHEN last_frame_ts IS NULL OR last_error_ts > last_frame_ts THEN txt END AS last_error FROM h"""))
def _st12(t):
    return sensors.camera_health(t.view("frames").withColumn("error", F.concat(F.lit("timeout "), F.col("frame_id").cast("string"))))


@query("st13_lane_snapshot", oracle=with_views("scan_events", "registry", body=DECIDED_SQL + """
SELECT lane_name, id, timestamp, plate_text, speed_mps, admission FROM (
  SELECT *, row_number() OVER (PARTITION BY lane_name ORDER BY timestamp DESC, id DESC) AS r FROM decided) q WHERE r = 1"""))
def _st13(t):
    return sensors.lane_snapshot(decided_events(t)).select("lane_name", "id", "timestamp", "plate_text", "speed_mps", "admission")


@query("st11_barrier_intervals", oracle=with_views("scan_events", "registry", body=DECIDED_SQL + """,
o AS (SELECT lane_name AS lane, timestamp AS ts, id, timestamp + INTERVAL 1 HOUR AS until FROM decided WHERE admission = 0),
r AS (SELECT *, max(until) OVER (PARTITION BY lane ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY ts, id) AS island FROM r)
SELECT lane, min(ts) AS open_from, max(until) AS open_until, count(*) AS n_openings FROM g GROUP BY lane, island"""))
def _st11(t):
    return sensors.barrier_intervals(decided_events(t), OPEN_S)


# Motion ------------------------------------------------------------------------------------------

NUMBERED_MOTION = "m AS (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY seq) - 1 AS no FROM v_motion)"


def numbered_motion(t):
    """Cameras number the frames of a pass; the derived rows get that number here."""
    from pyspark.sql import Window as W

    no = F.row_number().over(W.partitionBy("pass_id").orderBy("seq")) - 1
    return t.view("motion").withColumn("seq", no.cast("long"))


@query("w11_consecutive_pairs", oracle=with_views("motion", body="""
SELECT pass_id, seq, lag(seq) OVER (PARTITION BY pass_id ORDER BY seq) AS prev_seq FROM v_motion"""))
def _w11(t):
    return motion.consecutive_pairs(t.view("motion")).select("pass_id", "seq", "prev_seq")


@query("a9_motion_stats", oracle=with_views("motion", body=NUMBERED_MOTION + """
SELECT pass_id, count(*) AS n_frames, CAST(sum(frame_rows) AS BIGINT) AS rows_grabbed,
  count(*) FILTER (no > 0 AND abs(coalesce(dy, 0)) < 0.5) AS n_still,
  round(coalesce(sum(abs(dx)) FILTER (no > 0 AND dy IS NOT NULL), 0), 6) AS total_abs_dx,
  round(coalesce(sum(abs(dy)) FILTER (no > 0), 0), 6) AS total_abs_dy FROM m GROUP BY pass_id"""))
def _a9(t):
    out = motion.motion_stats(t.view("motion"))
    return out.withColumns({c: F.round(c, 6) for c in ("total_abs_dx", "total_abs_dy")})


@query("f10_coverage_check", oracle=with_views("motion", body="""
SELECT pass_id, 100 / 400E0 * 120E0 * 3.6E0 AS ceiling_kmh, max(abs(dy)) AS max_advance,
  count(*) FILTER (abs(dy) > 100) AS n_gap_frames FROM v_motion GROUP BY pass_id"""))
def _f10(t):
    short = t.view("motion").withColumn("frame_rows", F.lit(100))
    return motion.coverage_check(short, 400.0, 120.0)


_STRIPS_SQL = """,
seqs AS (SELECT pass_id, list(struct_pack(no := no, dy := coalesce(dy, 0E0)) ORDER BY no) AS xs FROM m WHERE no > 0 GROUP BY pass_id),
fold AS (SELECT pass_id, list_reduce(xs, lambda s, x: struct_pack(
    dir := CASE WHEN s.dir <> 0 THEN s.dir WHEN abs(s.pending + x.dy) < 24 THEN 0 ELSE CAST(sign(s.pending + x.dy) AS INTEGER) END,
    pending := CASE WHEN s.dir = 0 AND abs(s.pending + x.dy) < 24 THEN s.pending + x.dy
      WHEN s.dir = 0 THEN abs(s.pending + x.dy) - trunc(abs(s.pending + x.dy))
      ELSE greatest(s.pending + x.dy * s.dir, -48E0) - greatest(trunc(greatest(s.pending + x.dy * s.dir, -48E0)), 0E0) END,
    strips := CASE WHEN s.dir = 0 AND abs(s.pending + x.dy) < 24 THEN s.strips
      WHEN trunc(CASE WHEN s.dir = 0 THEN abs(s.pending + x.dy) ELSE greatest(s.pending + x.dy * s.dir, -48E0) END) <= 0 THEN s.strips
      ELSE list_append(s.strips, struct_pack(no := x.no, n := CAST(least(trunc(CASE WHEN s.dir = 0 THEN abs(s.pending + x.dy)
        ELSE greatest(s.pending + x.dy * s.dir, -48E0) END), 608) AS INTEGER),
        up := CASE WHEN s.dir = 0 THEN s.pending + x.dy > 0 ELSE s.dir > 0 END)) END),
  struct_pack(dir := CAST(0 AS INTEGER), pending := 0E0, strips := CAST([] AS STRUCT(no BIGINT, n INTEGER, up BOOLEAN)[]))) AS r FROM seqs),
strips AS (SELECT pass_id, s.no AS seq, s.n AS rows, s.up AS at_top FROM (SELECT pass_id, unnest(r.strips) AS s FROM fold) q)"""


def strips_sql(numbered=NUMBERED_MOTION):
    """Strips of the rows that ``numbered`` defines as m, as common table expressions."""
    return numbered + _STRIPS_SQL


STRIPS_SQL = strips_sql()


@query("w6_strip_plan", oracle=with_views("motion", body=STRIPS_SQL + "\nSELECT pass_id, seq, rows, at_top FROM strips"))
def _w6(t):
    return motion.strip_plan(numbered_motion(t))


@query("w7_recent_strips", oracle=with_views("motion", body=STRIPS_SQL + """,
c AS (SELECT *, sum(rows) OVER (PARTITION BY pass_id ORDER BY seq DESC) AS cum FROM strips)
SELECT pass_id, seq, rows, CASE WHEN at_top THEN -seq ELSE seq END AS image_order FROM c WHERE cum - rows < 200"""))
def _w7(t):
    return motion.recent_strips(motion.strip_plan(numbered_motion(t)), 200).select("pass_id", "seq", "rows", "image_order")


@query("a10_flow_peak", oracle=with_views("flow", body="""
b AS (SELECT frame_id, vx, vy, CASE WHEN abs(vy) >= 0.15E0 AND floor((vy + 64E0) / 0.02E0) BETWEEN 0 AND 6399
  THEN CAST(floor((vy + 64E0) / 0.02E0) AS INTEGER) END AS bin FROM v_flow),
n AS (SELECT frame_id, count(*) AS n_pixels FROM b GROUP BY frame_id),
h AS (SELECT frame_id, bin, count(*) AS c FROM b WHERE bin IS NOT NULL GROUP BY frame_id, bin),
d AS (SELECT n.frame_id, k.bin, coalesce(h.c, 0) AS c FROM n, range(6400) k(bin) LEFT JOIN h ON h.frame_id = n.frame_id AND h.bin = k.bin),
cu AS (SELECT frame_id, bin, sum(c) OVER (PARTITION BY frame_id ORDER BY bin) AS upto FROM d),
wd AS (SELECT frame_id, bin, greatest(0, bin - half) AS lo, least(6400, bin + half + 1) AS hi FROM (
  SELECT frame_id, bin, CAST(trunc(greatest(0.25E0, 0.2E0 * abs((bin + 0.5E0) * 0.02E0 - 64E0)) / 0.02E0) AS INTEGER) AS half FROM cu) q),
wc AS (SELECT w.*, a.upto - coalesce(z.upto, 0) AS c FROM wd w JOIN cu a ON a.frame_id = w.frame_id AND a.bin = w.hi - 1
  LEFT JOIN cu z ON z.frame_id = w.frame_id AND z.bin = w.lo - 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, bin) AS r FROM wc) q WHERE r = 1),
ok AS (SELECT b.* FROM best b JOIN n ON n.frame_id = b.frame_id JOIN wc m ON m.frame_id = b.frame_id AND m.bin = 6399 - b.bin
  WHERE b.c > 0 AND b.c >= 0.03E0 * n_pixels AND b.c >= 2E0 * m.c)
SELECT n.frame_id, n.n_pixels, CASE WHEN o.frame_id IS NOT NULL THEN count(b.bin) END AS n_peak,
  round(avg(b.vx) / 0.25E0, 6) AS dx, round(avg(b.vy) / 0.25E0, 6) AS dy
FROM n LEFT JOIN ok o ON o.frame_id = n.frame_id LEFT JOIN b ON b.frame_id = o.frame_id AND b.bin >= o.lo AND b.bin < o.hi
GROUP BY n.frame_id, n.n_pixels, o.frame_id"""))
def _a10(t):
    return motion.flow_peak(t.view("flow")).withColumns({"dx": F.round("dx", 6), "dy": F.round("dy", 6)})
