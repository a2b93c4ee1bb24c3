"""Lane configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import lanes
from gatewise.plans.registry import query
from gatewise.plans.tables import with_views

_POSITIONS = """
parsed AS (SELECT *, list_transform(list_filter(list_transform(string_split(loop_positions, ','), lambda p: trim(p)),
  lambda p: p <> ''), lambda p: CAST(p AS DOUBLE)) AS positions FROM v_controllers)"""


def cameras(t, kind):
    return t.view("cameras").filter(F.col("kind") == kind).drop("kind")


@query("f3_enabled_lanes", oracle=with_views("controllers", body="SELECT * FROM v_controllers WHERE enabled"))
def _f3(t):
    return lanes.enabled_lanes(t.view("controllers"))


@query("s6_lane_list", oracle=with_views("controllers", body="SELECT * FROM v_controllers"))
def _s6(t):
    return lanes.lane_list(t.view("controllers"))


@query("p16_parse_positions", oracle=with_views("controllers", body=_POSITIONS + """
SELECT lane_id, CAST(len(positions) AS INTEGER) AS n_loops, positions[1] AS entry_m, positions[-1] AS exit_m,
  len(positions) >= 2 AS usable FROM parsed"""))
def _p16(t):
    out = lanes.lane_positions(t.view("controllers"))
    return out.select("lane_id", F.size("positions").alias("n_loops"), F.get("positions", F.lit(0)).alias("entry_m"),
                      F.try_element_at("positions", F.lit(-1)).alias("exit_m"), "usable")


@query("j2_lane_config", oracle=with_views("controllers", "cameras", body="""
SELECT c.*, d.id AS driver_id, d.camera_name AS driver_camera_name, d.enabled AS driver_enabled,
  a.id AS anpr_id, a.camera_name AS anpr_camera_name, a.enabled AS anpr_enabled,
  u.id AS underbody_id, u.camera_name AS underbody_camera_name, u.enabled AS underbody_enabled
FROM v_controllers c LEFT JOIN v_cameras d ON d.lane_id = c.lane_id AND d.kind = 'driver'
LEFT JOIN v_cameras a ON a.lane_id = c.lane_id AND a.kind = 'anpr'
LEFT JOIN v_cameras u ON u.lane_id = c.lane_id AND u.kind = 'underbody'"""))
def _j2(t):
    return lanes.lane_config(t.view("controllers"), *(cameras(t, k) for k in lanes.CAMERA_KINDS))


@query("u2_device_inventory", oracle=with_views("controllers", "cameras", body="""
online AS (SELECT lane_id, kind FROM v_cameras WHERE enabled)
SELECT x.*, o.lane_id IS NOT NULL AS online FROM (
  SELECT id, lane_id, 'controller' AS kind, gate_name AS name FROM v_controllers
  UNION ALL SELECT id, lane_id, kind, camera_name FROM v_cameras) x
LEFT JOIN online o ON o.lane_id = x.lane_id AND o.kind = x.kind"""))
def _u2(t):
    status = t.view("cameras").filter("enabled").select("lane_id", "kind", F.lit(True).alias("online"))
    return lanes.device_inventory(t.view("controllers"), *(cameras(t, k) for k in lanes.CAMERA_KINDS), status)


# Edits derived from the supplier table: known ids, unknown ids, inserts, blank fields.
_CHANGES = """
SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 40 AS INT) END AS id,
  concat('lane', CAST(s_suppkey AS STRING)) AS lane_id, CASE WHEN s_suppkey % 6 = 0 THEN ' ' ELSE '10.0.0.1' END AS ip,
  CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS gate_name FROM supplier"""
_UPSERT_SQL = f"""
cur AS (SELECT id, lane_id, gate_name, '10.0.0.9' AS ip, enabled FROM v_controllers),
ch AS ({_CHANGES}),
chk AS (SELECT ch.*, CASE WHEN trim(ch.ip) = '' THEN 'ip is required' WHEN trim(ch.gate_name) = '' THEN 'gate_name is required'
  WHEN ch.id IS NOT NULL AND cur.id IS NULL THEN 'row no longer exists' END AS reason
  FROM ch LEFT JOIN cur ON cur.id = ch.id)"""


def _upsert(t):
    current = t.view("controllers").select("id", "lane_id", "gate_name", F.lit("10.0.0.9").alias("ip"), "enabled")
    changes = t.spark.sql(_CHANGES.replace("FROM supplier", "FROM {s}"), s=t.table("supplier"))
    return lanes.upsert_lane_table(current, changes, "controller")


@query("snk7_upsert_lane_table", oracle=with_views("controllers", body=_UPSERT_SQL + """,
upd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM chk
  WHERE reason IS NULL AND id IS NOT NULL) q WHERE r = 1),
ins AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM chk WHERE reason IS NULL AND id IS NULL)
SELECT cur.id, coalesce(u.lane_id, cur.lane_id) AS lane_id, coalesce(u.gate_name, cur.gate_name) AS gate_name,
  coalesce(u.ip, cur.ip) AS ip, cur.enabled FROM cur LEFT JOIN upd u ON u.id = cur.id
UNION ALL SELECT CAST((SELECT max(id) FROM cur) + r AS INTEGER), lane_id, gate_name, ip, NULL FROM ins"""))
def _snk7(t):
    return _upsert(t)[0]


@query("snk7_upsert_rejected", oracle=with_views("controllers", body=_UPSERT_SQL + """
SELECT seq, id, reason FROM chk WHERE reason IS NOT NULL"""))
def _snk7_rejected(t):
    return _upsert(t)[1].select("seq", "id", "reason")
