"""Domain views derived from the generic input tables.

The input tables are not gate data, so every registered query reads one of
these deterministic projections. The text is portable SQL: Spark runs it over
DataFrames, the oracle inlines it as a common table expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.session import scratch_path

TABLES = ("events", "customer", "embeddings", "nation", "supplier", "lineitem")

_PLATE = (
    "concat(CASE user_id % 8 WHEN 0 THEN 'DL' WHEN 1 THEN 'HR' WHEN 2 THEN 'UP' WHEN 3 THEN 'MH'"
    " WHEN 4 THEN 'KA' WHEN 5 THEN 'TN' WHEN 6 THEN 'GJ' ELSE 'WB' END,"
    " lpad(CAST(user_id % 90 + 10 AS STRING), 2, '0'), chr(CAST(65 + user_id % 26 AS INT)),"
    " chr(CAST(65 + (user_id * 7) % 26 AS INT)), lpad(CAST((user_id * 37) % 10000 AS STRING), 4, '0'))"
)
_LANE = "concat('lane', CAST(user_id % 4 + 1 AS STRING))"

VIEWS: dict[str, str] = {
    "scan_events": f"""
        SELECT event_id + 1 AS id, ts AS timestamp, {_LANE} AS lane_name,
          CASE WHEN event_id % 11 = 0 THEN '' ELSE {_PLATE} END AS plate_text,
          value / 100 AS speed_mps, event_id % 3 <> 0 AS plate_text_valid,
          event_type = 'error' AS foreign_object_detected
        FROM events""",
    "registry": f"""
        SELECT user_id AS id,
          CASE user_id % 3 WHEN 0 THEN lower(p) WHEN 1 THEN concat(substr(p, 1, 4), ' ', substr(p, 5))
            ELSE concat(substr(p, 1, 2), '-', substr(p, 3)) END AS license_plate,
          CASE WHEN user_id % 7 = 0 THEN '' ELSE c_name END AS owner_name,
          CAST(user_id % 3 AS INT) AS classification,
          CASE WHEN user_id % 4 = 0 THEN '' ELSE c_mktsegment END AS notes
        FROM (SELECT *, {_PLATE} AS p FROM (SELECT c_custkey AS user_id, c_name, c_mktsegment FROM customer) a) b
        UNION ALL
        SELECT user_id + 100000000, {_PLATE}, 'duplicate', 2, 'later entry'
        FROM (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 10 = 1) c""",
    "plate_reads": f"""
        SELECT user_id * 10 + CAST(floor((day(ts) - 1) / 5.0) AS BIGINT) AS pass_id, event_id AS seq,
          CASE event_id % 7 WHEN 0 THEN replace(p, '0', 'O') WHEN 1 THEN concat(p, '9') WHEN 2 THEN substr(p, 2)
            WHEN 3 THEN '' WHEN 4 THEN replace(p, 'D', 'O') ELSE p END AS plate_text,
          event_id % 13 <> 0 AS has_bbox,
          0.5E0 + CAST(event_id % 50 AS DOUBLE) / 100 AS confidence,
          0.4E0 + CAST(event_id % 31 AS DOUBLE) / 100 AS quality,
          20 + CAST(event_id % 200 AS DOUBLE) AS sharpness
        FROM (SELECT *, {_PLATE} AS p FROM events) e""",
    "loop_states": f"""
        SELECT {_LANE} AS lane, ts, event_id AS seq, event_type IN ('click', 'view') AS loop0,
          event_type IN ('view', 'purchase') AS loop1, event_type = 'signup' AS heartbeat
        FROM events""",
    "loop_lines": f"""
        SELECT {_LANE} AS lane, ts, event_id AS seq,
          CASE event_type WHEN 'click' THEN 'STATE 1 0' WHEN 'view' THEN ' state 1 1 0'
            WHEN 'purchase' THEN 'STATE 0' WHEN 'signup' THEN '|HLT%'
            ELSE CASE WHEN event_id % 2 = 0 THEN 'STATE' ELSE 'garbled 1 1' END END AS line
        FROM events""",
    "motion": """
        SELECT user_id AS pass_id, event_id AS seq, 1216 AS frame_rows, value / 10 - 1 AS dx,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE 20 - value END AS dy
        FROM events""",
    "patches": """
        SELECT CAST(floor(vec_id / 10.0) AS BIGINT) AS image_id, CAST(vec_id % 10 AS INT) AS cell,
          embedding AS feat, label
        FROM embeddings""",
    "boxes": """
        SELECT l_orderkey AS image_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS box_id, CAST(l_partkey % 40 AS INT) AS x,
          CAST(l_suppkey % 40 AS INT) AS y, 20 + CAST(l_quantity AS INT) AS w,
          20 + CAST(l_partkey % 17 AS INT) AS h, CAST(l_partkey % 3 AS INT) AS class_id,
          0.3E0 + CAST((l_partkey * 31 + l_linenumber) % 700 AS DOUBLE) / 1000 AS conf
        FROM lineitem""",
    "ctc_steps": """
        SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
          CAST(CASE WHEN value < 8 THEN 0 WHEN value < 25 THEN 1 + user_id % 36
            ELSE 1 + (user_id * 5) % 36 END AS INT) AS class_idx,
          0.5E0 + CAST(event_id % 50 AS DOUBLE) / 100 AS prob
        FROM events""",
    "frames": f"""
        SELECT event_id AS frame_id, {_LANE} AS lane, ts,
          CASE WHEN event_id % 2 = 0 THEN 'driver' ELSE 'anpr' END AS camera,
          event_type <> 'error' AS delivered, CASE WHEN event_id % 5 = 0 THEN 0.0E0 ELSE value END AS score
        FROM events""",
    "passes": f"""
        SELECT event_id AS pass_id, {_LANE} AS lane, ts AS entry_ts,
          CASE WHEN event_id % 9 <> 0 THEN ts + INTERVAL 4 HOUR END AS exit_engage_ts,
          CASE WHEN event_id % 9 <> 0 AND event_id % 10 <> 0 THEN ts + INTERVAL 6 HOUR END AS exit_clear_ts,
          event_id % 17 = 0 AS frame_cap_hit,
          CASE WHEN event_id % 11 = 0 THEN '' ELSE {_PLATE} END AS plate_text, event_id % 6 = 0 AS foreign_object
        FROM events WHERE event_type = 'view'""",
    "flow": """
        SELECT l_orderkey % 50 AS frame_id, l_orderkey * 10 + l_linenumber AS px,
          CAST(l_suppkey % 11 AS DOUBLE) / 10 - 0.5E0 AS vx,
          CASE WHEN l_linenumber <= 4 THEN 5 + CAST(l_partkey % 7 AS DOUBLE) / 32
            ELSE CAST(l_partkey % 101 AS DOUBLE) / 50 - 1 END AS vy
        FROM lineitem""",
    "eval": f"""
        SELECT line_no, filename, label,
          CASE WHEN line_no % 8 = 0 THEN replace(label, '1', '7') ELSE label END AS plate_text,
          line_no % 10 <> 3 AS image_exists
        FROM (SELECT event_id AS line_no,
            concat(CASE event_id % 3 WHEN 0 THEN 'new_' WHEN 1 THEN 'old_' ELSE 'x_' END,
              CAST(event_id AS STRING), '.jpg') AS filename,
            {_PLATE} AS label FROM events) e""",
    "controllers": """
        SELECT n_nationkey AS id, concat('lane', CAST(n_nationkey AS STRING)) AS lane_id, n_name AS gate_name,
          n_nationkey % 4 <> 0 AS enabled,
          CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN '0, 1.5,3' ELSE '0,3' END AS loop_positions
        FROM nation""",
    "cameras": """
        SELECT CAST(s_suppkey AS INT) AS id,
          concat('lane', CAST(CAST(floor(s_suppkey / 3.0) AS INT) AS STRING)) AS lane_id,
          CASE s_suppkey % 3 WHEN 0 THEN 'driver' WHEN 1 THEN 'anpr' ELSE 'underbody' END AS kind,
          s_name AS camera_name, s_suppkey % 7 <> 0 AS enabled
        FROM supplier""",
}


@dataclass
class Arrivals:
    """A table that comes piece by piece: the stream of what has come, and the steps that bring the pieces."""

    stream: DataFrame
    steps: list[Callable[[], None]]


class Tables:
    """Reads the input tables of one folder and serves the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def stream(self, name: str) -> DataFrame:
        """The table as a bounded file stream."""
        schema = self.table(name).schema
        return (
            self.spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.sf_dir)
        )

    def arrivals(self, name: str, came: Column, n: int) -> Arrivals:
        """The table as ``n`` arrivals of equal spans of the time ``came``, at which rows come."""
        rows, folder = self.table(name), scratch_path(self.spark, f"{name}-arrivals")
        us = F.unix_micros(came.cast("timestamp"))
        lo, hi = rows.agg(F.min(us), F.max(us)).first()
        place = F.least(F.lit(n - 1), F.call_function("div", (us - lo) * n, F.lit(max(hi - lo, 1))))
        rows.limit(0).write.parquet(folder)
        steps = [lambda k=k: rows.filter(place == k).write.mode("append").parquet(folder) for k in range(n)]
        return Arrivals(self.spark.readStream.schema(rows.schema).parquet(folder), steps)

    def view(self, name: str, source: DataFrame | None = None) -> DataFrame:
        """A derived view; ``source`` replaces the stored ``events`` table (for streams)."""
        return derive(self.spark, name, source if source is not None else self.table)


def derive(spark: SparkSession, name: str, source) -> DataFrame:
    text = VIEWS[name]
    needed = [t for t in TABLES if f"FROM {t}" in text]
    frames = {}
    for t in needed:
        frames[t] = source(t) if callable(source) and not isinstance(source, DataFrame) else source
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """Oracle text: the named views as common table expressions in front of ``body``.

    ``body`` starts either with SELECT or with further ``name AS (...)`` expressions.
    """
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = ",\n".join(f"v_{n} AS ({VIEWS[n]})" for n in names)
    text = body.strip()
    glue = "\n" if text.upper().startswith("SELECT") else ",\n"
    return head + ctes + glue + text
