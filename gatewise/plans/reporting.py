"""Decision and reporting queries over stored events, registry and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import decisions, registry, reports
from gatewise.plans.registry import query
from gatewise.plans.tables import Tables, with_views
from gatewise.session import scratch_path
from gatewise.sources import readers, writers

FLAGSHIP = "flagship_admission_by_lane"

# Oracle building block: registry matched to the derived events, and the decision on each.
MATCHED_SQL = r"""
reg AS (
  SELECT * FROM (
    SELECT upper(regexp_replace(license_plate, '[^\p{L}\p{Nd}]', '', 'g')) AS k, id AS registry_id, owner_name,
      classification, notes AS registry_notes,
      row_number() OVER (PARTITION BY upper(regexp_replace(license_plate, '[^\p{L}\p{Nd}]', '', 'g')) ORDER BY id) AS rn
    FROM v_registry) r WHERE rn = 1),
matched AS (
  SELECT e.*, r.registry_id, r.owner_name, r.classification, r.registry_notes
  FROM v_scan_events e LEFT JOIN reg r
    ON trim(e.plate_text) <> '' AND upper(regexp_replace(e.plate_text, '[^\p{L}\p{Nd}]', '', 'g')) = r.k)"""
DECIDED_SQL = MATCHED_SQL + r""",
decided AS (
  SELECT m.*, CASE WHEN coalesce(owner_name, '') <> '' THEN owner_name ELSE 'Unknown' END AS driver_name,
    CAST(CASE WHEN foreign_object_detected THEN 2 WHEN classification = 2 THEN 2 WHEN classification = 1 THEN 0
      ELSE 1 END AS INTEGER) AS admission,
    CASE WHEN foreign_object_detected AND classification = 2 THEN trim('CRITICAL ALERT: Blacklisted vehicle with a flagged scan region! ' || registry_notes)
      WHEN foreign_object_detected THEN trim('THREAT DETECTED: foreign-object scan flagged this pass -- manual inspection required. ' || coalesce(registry_notes, ''))
      WHEN classification = 2 THEN trim('CRITICAL ALERT: Blacklisted vehicle! ' || registry_notes)
      WHEN classification = 1 THEN trim('Auto-Approved: Registered vehicle. ' || registry_notes)
      WHEN registry_id IS NOT NULL THEN trim('Scan complete. No anomalies detected. ' || registry_notes)
      ELSE 'Scan complete. No anomalies detected. Vehicle not in registry.' END AS dossier_notes
  FROM matched m)"""
RECENT_SQL = DECIDED_SQL + """,
recent AS (SELECT * FROM decided ORDER BY id DESC LIMIT 500)"""
ADMISSION_SQL = "CASE admission WHEN 0 THEN 'Approved' WHEN 1 THEN 'Pending' ELSE 'Denied' END"


def decided_events(t: Tables):
    """Derived events with registry match and admission decision."""
    return decisions.decide_admission(registry.match_registry(t.view("scan_events"), t.view("registry")))


def _decided(body: str, recent: bool = False) -> str:
    return with_views("scan_events", "registry", body=(RECENT_SQL if recent else DECIDED_SQL) + "\n" + body)


@query(FLAGSHIP, oracle=_decided("""
SELECT lane_name, count(*) AS total, count(*) FILTER (admission = 0) AS approved,
  count(*) FILTER (admission = 2) AS denied, count(*) FILTER (foreign_object_detected) AS threats
FROM decided GROUP BY lane_name"""))
def _flagship(t):
    return reports.kpi_totals(decided_events(t), limit=None, by="lane_name")


_EVENT_COLS = ["id", "timestamp", "lane_name", "plate_text", "speed_mps", "plate_text_valid",
               "foreign_object_detected", "driver_name", "admission", "dossier_notes"]


@query("src1_read_scan_events", oracle=_decided(
    f"SELECT {', '.join(_EVENT_COLS)} FROM decided WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"))
def _src1(t):
    path = scratch_path(t.spark, "scan_events")
    writers.append_scan_events(decided_events(t), path)
    days = F.col("event_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    return readers.read_scan_events(t.spark, path).filter(days).select(_EVENT_COLS)


@query("src1_read_scan_events_all", oracle=_decided(f"SELECT {', '.join(_EVENT_COLS)} FROM decided"))
def _src1_all(t):
    path = scratch_path(t.spark, "scan_events")
    writers.append_scan_events(decided_events(t), path)
    return readers.read_scan_events(t.spark, path).select(_EVENT_COLS)


@query("snk1_append_scan_events", oracle=_decided(
    "SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS n_events, max(id) AS max_id, "
    "count(*) FILTER (admission = 0) AS approved FROM decided WHERE id % 13 <> 0 GROUP BY 1"))
def _snk1(t):
    path = scratch_path(t.spark, "append")
    scanned = decided_events(t).withColumn("n_frames", F.when(F.col("id") % 13 == 0, 0).otherwise(5))
    writers.append_scan_events(scanned, path)
    return readers.read_scan_events(t.spark, path).groupBy("event_date").agg(
        F.count("*").alias("n_events"), F.max("id").alias("max_id"), F.count_if(F.col("admission") == 0).alias("approved"))


@query("snk2_delete_scan_events", oracle=with_views("scan_events", body="""
SELECT id, lane_name, plate_text FROM v_scan_events
WHERE NOT (id % 5 = 0 AND CAST(timestamp AS DATE) < DATE '2024-01-10')"""))
def _snk2(t):
    path = scratch_path(t.spark, "delete")
    events = t.view("scan_events")
    writers.append_scan_events(events, path)
    unknown = t.spark.range(1).select(F.lit(-1).cast("long").alias("id"))
    early = events.filter("id % 5 = 0 AND timestamp < TIMESTAMP_NTZ '2024-01-10'").select("id")
    writers.delete_scan_events(t.spark, path, early.unionByName(unknown))
    return readers.read_scan_events(t.spark, path).select("id", "lane_name", "plate_text")


@query("snk3_registry_add", oracle=with_views("registry", "scan_events", body="""
fresh AS (SELECT id AS seq, plate_text, lane_name FROM v_scan_events WHERE foreign_object_detected),
valid AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM fresh WHERE trim(plate_text) <> '')
SELECT * FROM v_registry UNION ALL
SELECT (SELECT max(id) FROM v_registry) + rn, plate_text, lane_name, CAST(2 AS INTEGER), 'flagged' FROM valid"""))
def _snk3_add(t):
    rows = t.view("scan_events").filter("foreign_object_detected").select(
        F.col("id").alias("seq"),
        F.concat(F.lit("  "), "plate_text", F.lit(" ")).alias("license_plate"),
        F.concat(F.lit(" "), "lane_name").alias("owner_name"),
        F.lit(2).alias("classification"),
        F.lit("flagged ").alias("notes"),
    )
    return registry.registry_add(t.view("registry"), rows)


@query("snk3_registry_remove", oracle=with_views("registry", body="""
SELECT * FROM v_registry WHERE id NOT IN (SELECT id FROM v_registry WHERE owner_name = '')"""))
def _snk3_remove(t):
    reg = t.view("registry")
    return registry.registry_remove(reg, reg.filter("owner_name = ''").select("id"))


@query("snk4_image_paths", oracle=with_views("scan_events", body="""
SELECT id, CASE WHEN plate_text <> '' THEN concat('/data/images/', strftime(timestamp, '%Y-%m-%d'), '/', lane_name, '_',
  strftime(timestamp, '%Y%m%d_%H%M%S_%g'), '_highlighted.jpg') END AS image_path FROM v_scan_events"""))
def _snk4(t):
    with_bytes = t.view("scan_events").withColumn("image", F.encode("plate_text", "UTF-8"))
    return writers.image_paths(with_bytes, "/data/images", suffix="highlighted").select("id", "image_path")


@query("f1_history_search", oracle=_decided("""
SELECT id, plate_text, admission FROM recent
WHERE contains(lower(plate_text), 'hr') AND admission = 1
  AND CAST(timestamp AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""", recent=True))
def _f1(t):
    return reports.history_search(decided_events(t), "hR", "Pending", "2024-01-03", "2024-01-25").select(
        "id", "plate_text", "admission")


@query("f1_history_search_all", oracle=_decided("""
SELECT id, plate_text, admission, timestamp FROM decided
WHERE contains(lower(plate_text), 'ka') AND CAST(timestamp AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"""))
def _f1_all(t):
    return reports.history_search(decided_events(t), "ka", "", "2024-01-03", "2024-01-25", limit=None).select(
        "id", "plate_text", "admission", "timestamp")


@query("f2_registry_search", oracle=with_views("registry", body="""
SELECT * FROM v_registry WHERE contains(lower(license_plate), 'hr') AND classification = 1"""))
def _f2(t):
    return registry.registry_search(t.view("registry"), "Hr", 1)


@query("f4_history_rows", oracle=_decided(f"""
SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS inspected_at,
  CASE WHEN plate_text = '' THEN '-' ELSE plate_text END AS plate,
  CASE WHEN foreign_object_detected THEN 'Threat' ELSE 'Clean' END AS threat_scan,
  {ADMISSION_SQL} AS admission FROM decided"""))
def _f4(t):
    return reports.history_rows(decided_events(t))


@query("f5_pass_detail", oracle=_decided("""
SELECT id, lane_name, plate_text, CASE WHEN plate_text_valid THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS plate_status
FROM recent WHERE id = (SELECT max(id) - 100 FROM decided)""", recent=True))
def _f5(t):
    events = decided_events(t)
    wanted = events.agg(F.max("id")).first()[0] - 100
    return reports.pass_detail(events, wanted).select("id", "lane_name", "plate_text", "plate_status")


@query("f9_decide_admission", oracle=_decided(
    "SELECT id, driver_name, admission, dossier_notes FROM decided"))
def _f9(t):
    return decided_events(t).select("id", "driver_name", "admission", "dossier_notes")


@query("j1_match_registry", oracle=with_views("scan_events", "registry", body=MATCHED_SQL + """
SELECT id, plate_text, registry_id, owner_name, classification, registry_notes FROM matched"""))
def _j1(t):
    return registry.match_registry(t.view("scan_events"), t.view("registry")).select(
        "id", "plate_text", "registry_id", "owner_name", "classification", "registry_notes")


@query("j10_unregistered_passes", oracle=with_views("scan_events", "registry", body=MATCHED_SQL + """
SELECT id, plate_text FROM matched WHERE registry_id IS NULL"""))
def _j10(t):
    return registry.unregistered_passes(t.view("scan_events"), t.view("registry")).select("id", "plate_text")


@query("a1_kpi_totals", oracle=_decided("""
SELECT count(*) AS total, count(*) FILTER (admission = 0) AS approved, count(*) FILTER (admission = 2) AS denied,
  count(*) FILTER (foreign_object_detected) AS threats FROM recent""", recent=True))
def _a1(t):
    return reports.kpi_totals(decided_events(t))


@query("a2_hourly_distribution", oracle=with_views("scan_events", body="""
SELECT CAST(h.h AS INTEGER) AS hour, count(e.id) AS n_events FROM range(24) h(h)
LEFT JOIN v_scan_events e ON hour(e.timestamp) = h.h GROUP BY 1"""))
def _a2(t):
    return reports.hourly_distribution(t.view("scan_events"), limit=None)


@query("a2_hourly_distribution_recent", oracle=with_views("scan_events", body="""
recent AS (SELECT * FROM v_scan_events ORDER BY id DESC LIMIT 500)
SELECT CAST(h.h AS INTEGER) AS hour, count(e.id) AS n_events FROM range(24) h(h)
LEFT JOIN recent e ON hour(e.timestamp) = h.h GROUP BY 1"""))
def _a2_recent(t):
    return reports.hourly_distribution(t.view("scan_events"))


@query("a3_safety_split", oracle=_decided("""
SELECT count(*) AS total, count(*) FILTER (NOT foreign_object_detected) AS cleared,
  count(*) FILTER (foreign_object_detected) AS threats,
  count(*) FILTER (NOT foreign_object_detected) / CAST(count(*) AS DOUBLE) AS cleared_share,
  count(*) FILTER (foreign_object_detected) / CAST(count(*) AS DOUBLE) AS threat_share FROM decided"""))
def _a3(t):
    return reports.safety_split(decided_events(t), limit=None)


@query("s1_recent_events", oracle=with_views("scan_events", body="""
SELECT id, lane_name, plate_text FROM v_scan_events ORDER BY id DESC LIMIT 500"""))
def _s1(t):
    return reports.recent_events(t.view("scan_events")).select("id", "lane_name", "plate_text")


@query("s2_lane_log", oracle=with_views("scan_events", body="""
SELECT id, lane_name, plate_text FROM v_scan_events ORDER BY id DESC LIMIT 15"""))
def _s2(t):
    return reports.lane_log(t.view("scan_events")).select("id", "lane_name", "plate_text")


@query("s2_lane_log_per_lane", oracle=with_views("scan_events", body="""
SELECT id, lane_name, plate_text FROM (SELECT *, row_number() OVER (PARTITION BY lane_name ORDER BY id DESC) AS r
FROM v_scan_events) x WHERE r <= 15"""))
def _s2_lane(t):
    return reports.lane_log(t.view("scan_events"), per_lane=True).select("id", "lane_name", "plate_text")


@query("s6_registry_list", oracle=with_views("registry", body="SELECT * FROM v_registry"))
def _s6(t):
    return registry.registry_list(t.view("registry"))


# Evaluation reports ------------------------------------------------------------------------------

def _labels(t):
    return t.view("eval").select("line_no", "filename", "label")


def _reads(t):
    return t.view("eval").select("filename", F.col("plate_text").alias("text"))


def _images(t):
    return t.view("eval").filter("image_exists").select("filename")


def evaluated(t):
    return reports.join_eval(reports.labels_with_image(_labels(t), _images(t)), _reads(t))


_EVAL_SQL = "e AS (SELECT *, label = plate_text AS correct FROM v_eval WHERE image_exists)\n"


@query("j7_join_eval", oracle=with_views("eval", body=_EVAL_SQL + """
SELECT filename, label, plate_text AS text, correct FROM e"""))
def _j7(t):
    return evaluated(t).select("filename", "label", "text", "correct")


@query("j7_diff_reports", oracle=with_views("eval", body="""
a AS (SELECT filename, label, plate_text AS text FROM v_eval WHERE image_exists),
b AS (SELECT filename, label, label AS text FROM v_eval WHERE line_no % 17 <> 0)
SELECT coalesce(a.filename, b.filename) AS filename, a.label AS label_left, a.text AS text_left, b.label AS label_right,
  b.text AS text_right FROM a FULL JOIN b ON a.filename = b.filename
WHERE a.filename IS NULL OR b.filename IS NULL OR a.text <> b.text"""))
def _j7_diff(t):
    first = t.view("eval").filter("image_exists").select("filename", "label", F.col("plate_text").alias("text"))
    second = t.view("eval").filter("line_no % 17 <> 0").select("filename", "label", F.col("label").alias("text"))
    return reports.diff_reports(first, second)


@query("j9_labels_with_image", oracle=with_views("eval", body="""
SELECT line_no, filename, label FROM v_eval WHERE image_exists"""))
def _j9(t):
    return reports.labels_with_image(_labels(t), _images(t))


@query("a8_accuracy", oracle=with_views("eval", body=_EVAL_SQL + """,
s AS (SELECT CASE WHEN filename LIKE 'new!_%' ESCAPE '!' THEN 'new' WHEN filename LIKE 'old!_%' ESCAPE '!' THEN 'old'
  ELSE 'other' END AS source, correct FROM e),
u AS (SELECT source, correct FROM s UNION ALL SELECT 'overall', correct FROM s)
SELECT source, count(*) FILTER (correct) AS n_correct, count(*) AS n_total,
  100.0E0 * count(*) FILTER (correct) / count(*) AS percent FROM u GROUP BY source"""))
def _a8(t):
    return reports.accuracy(evaluated(t))


@query("s5_mismatches", oracle=with_views("eval", body=_EVAL_SQL + """
SELECT line_no, filename, label, plate_text AS text FROM e WHERE NOT correct ORDER BY line_no LIMIT 20"""))
def _s5(t):
    return reports.mismatches(evaluated(t)).select("line_no", "filename", "label", "text")


@query("snk5_write_eval_report", oracle=with_views("eval", body=_EVAL_SQL + """
SELECT filename, label, plate_text AS text, CAST(printf('%.4f', 0.5E0 + line_no % 50 / 100.0E0) AS DOUBLE) AS confidence,
  'original:raw' AS variant, correct FROM e"""))
def _snk5(t):
    path = scratch_path(t.spark, "eval_report")
    rows = evaluated(t).withColumns({
        "confidence": F.lit(0.5) + F.col("line_no") % 50 / F.lit(100.0), "variant": F.lit("original:raw")})
    writers.write_eval_report(rows, path)
    return readers.read_eval_tsv(t.spark, path, header=True)
