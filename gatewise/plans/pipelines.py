"""The three end-to-end jobs: pass to event, reads to plate, clean images to bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.operators import decisions, evidence, grammar, registry, sensors, voting
from gatewise.operators.models import apply_model
from gatewise.plans import plate_text, sensing
from gatewise.plans import voting as vote_queries
from gatewise.plans.plate_text import valid
from gatewise.plans.registry import query
from gatewise.plans.tables import with_views
from gatewise.session import cut_lineage
from gatewise.sources import readers, writers


def plates_of_passes(passes: DataFrame, reads: DataFrame, max_s: float = 30.0) -> DataFrame:
    """Reads taken during each pass, reduced to its best frames and voted into one plate with state."""
    inside = sensors.frames_in_pass(passes, reads, max_s).select("pass_id", *[c for c in reads.columns if c not in ("lane", "ts")])
    voted = voting.vote_plate(voting.best_plate_frames(inside))
    return grammar.with_state_name(voted, "plate_state_code", "plate_state_name")


def events_of_passes(passes: DataFrame, plates: DataFrame, flags: DataFrame, reg: DataFrame, lanes: DataFrame) -> DataFrame:
    """One scan event per completed pass: speed, plate, registry match, admission and dossier."""
    done = decisions.pass_metrics(passes.filter("exit_clear_ts IS NOT NULL"), lanes)
    joined = done.join(plates, "pass_id", "left").join(flags, "pass_id", "left")
    filled = joined.withColumns({
        "plate_text": F.coalesce("plate_text", F.lit("")),
        "plate_state_name": F.coalesce("plate_state_name", F.lit("")),
        "plate_text_valid": F.coalesce("plate_text_valid", F.lit(False)),
        "foreign_object_detected": F.coalesce("foreign_object_detected", F.lit(False)),
        "timestamp": F.col("exit_clear_ts"), "lane_name": F.col("lane"), "id": F.col("pass_id"),
    })
    return decisions.decide_admission(registry.match_registry(filled, reg))


def build_bank(spark, image_dir: str, load, schema, path: str, n: int = evidence.BANK_VECTORS) -> None:
    """Clean images to a bank: list, extract patch vectors with the caller's model, sample, store.

    The model sees (path, length) rows and returns image_id, cell, feat; unreadable images give none.
    """
    vectors = apply_model(readers.list_images(spark, image_dir), load, schema)
    writers.write_bank(evidence.sample_bank(vectors, n), path)


def _detected(t) -> DataFrame:
    """Passes of the derived sensor rows, stored once because several steps read them."""
    passes = sensors.detect_passes(sensing.states(t), debounce_s=sensing.DEBOUNCE_S, max_s=sensing.MAX_PASS_S)
    return cut_lineage(passes.withColumn("pass_id", _pass_id(F.col("lane"), F.col("entry_ts"))), "passes")


def _pass_id(lane, entry):
    """Lane and entry time name a pass; nothing of either is cut."""
    return F.concat(lane, F.lit("@"), F.unix_micros(entry.cast("timestamp")).cast("string"))


def _timed_reads(t):
    frames = t.view("frames").select(F.col("frame_id").alias("seq"), "lane", "ts")
    return t.view("plate_reads").drop("pass_id").join(frames, "seq")


_PASS_READS = """
px AS (SELECT *, lane || '@' || CAST(epoch_us(entry_ts) AS VARCHAR) AS name, row_number() OVER (ORDER BY lane, entry_ts) AS pass_id FROM passes),
pass_reads AS (SELECT px.pass_id, r.* EXCLUDE (pass_id) FROM px JOIN (SELECT r.*, f.lane, f.ts FROM v_plate_reads r JOIN v_frames f ON f.frame_id = r.seq) r
  ON r.lane = px.lane AND r.ts >= px.entry_ts AND r.ts <= coalesce(px.exit_clear_ts, px.entry_ts + INTERVAL 1 HOUR)),
"""
_VOTED_PASSES = sensing.passes_sql() + "," + _PASS_READS + vote_queries._BEST_SQL.replace("FROM v_plate_reads", "FROM pass_reads")
_VIEWS = ("loop_states", "frames", "plate_reads", "registry", "controllers")


@query("e2_reads_to_plate", oracle=with_views(*_VIEWS[:3], recursive=True, body=_VOTED_PASSES + """
SELECT px.name AS pass_id, coalesce(w.consensus, f.plate_text) AS plate_text, CAST(coalesce(w.votes, 0) AS INTEGER) AS votes, round(coalesce(w.score, 0E0), 9) AS score,
  coalesce((SELECT name FROM codes WHERE code = substr(w.consensus, 1, 2)), '') AS plate_state_name FROM fb f JOIN px ON px.pass_id = f.pass_id LEFT JOIN win w ON w.pass_id = f.pass_id"""))
def _e2(t):
    passes = _detected(t)
    plates = plates_of_passes(passes, _timed_reads(t), sensing.MAX_PASS_S)
    return plates.select("pass_id", "plate_text", "votes", F.round("score", 9).alias("score"), "plate_state_name")


@query("e1_pass_to_event", oracle=with_views(*_VIEWS, recursive=True, body=_VOTED_PASSES + f""",
pos AS (SELECT lane_id, list_transform(list_filter(list_transform(string_split(loop_positions, ','), lambda p: trim(p)), lambda p: p <> ''),
  lambda p: CAST(p AS DOUBLE)) AS q FROM v_controllers),
plates AS (SELECT f.pass_id, coalesce(w.consensus, f.plate_text) AS plate_text, coalesce(w.votes >= 7 AND {valid('w.consensus')}, false) AS ok
  FROM fb f LEFT JOIN win w ON w.pass_id = f.pass_id),
""" + r"""
reg AS (SELECT * FROM (SELECT upper(regexp_replace(license_plate, '[^\p{L}\p{Nd}]', '', 'g')) AS k, id, classification, notes,
  row_number() OVER (PARTITION BY upper(regexp_replace(license_plate, '[^\p{L}\p{Nd}]', '', 'g')) ORDER BY id) AS rn FROM v_registry) z WHERE rn = 1)
SELECT px.name AS id, px.lane AS lane_name, px.exit_clear_ts AS timestamp, coalesce(p.plate_text, '') AS plate_text, coalesce(p.ok, false) AS plate_text_valid,
  CASE WHEN px.exit_engage_ts > px.entry_ts THEN (pos.q[-1] - pos.q[1]) / ((epoch_us(px.exit_engage_ts) - epoch_us(px.entry_ts)) / 1e6) ELSE 0E0 END AS speed_mps,
  CAST(CASE WHEN epoch_us(px.entry_ts) % 6 = 0 THEN 2 WHEN r.classification = 2 THEN 2 WHEN r.classification = 1 THEN 0 ELSE 1 END AS INTEGER) AS admission
FROM px JOIN pos ON pos.lane_id = px.lane LEFT JOIN plates p ON p.pass_id = px.pass_id
LEFT JOIN reg r ON trim(coalesce(p.plate_text, '')) <> '' AND r.k = upper(regexp_replace(p.plate_text, '[^\p{L}\p{Nd}]', '', 'g'))
WHERE px.exit_clear_ts IS NOT NULL"""))
def _e1(t):
    from gatewise.operators import lanes

    passes = _detected(t)
    flags = passes.select("pass_id", (F.unix_micros(F.col("entry_ts").cast("timestamp")) % 6 == 0).alias("foreign_object_detected"))
    plates = plates_of_passes(passes, _timed_reads(t), sensing.MAX_PASS_S)
    events = events_of_passes(passes, plates, flags, t.view("registry"), lanes.lane_positions(t.view("controllers")))
    return events.select("id", "lane_name", "timestamp", "plate_text", "plate_text_valid", "speed_mps", "admission")
