"""Source and hook queries: stored forms are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import sensors, voting
from gatewise.operators.models import apply_model
from gatewise.plans import sensing
from gatewise.plans import voting as vote_queries
from gatewise.plans.registry import query
from gatewise.plans.tables import with_views
from gatewise.session import scratch_path
from gatewise.sources import named_files, readers, writers
from gatewise.streaming import runtime


@query("src2_read_registry", oracle=with_views("registry", body="SELECT * FROM v_registry"))
def _src2(t):
    path = scratch_path(t.spark, "registry")
    writers.write_registry(t.view("registry"), path)
    return readers.read_registry(t.spark, path)


@query("src3_read_lane_tables", oracle=with_views("controllers", "cameras", body="""
SELECT 'controllers' AS source, id, lane_id, gate_name AS name, '10.0.0.1' AS ip FROM v_controllers
UNION ALL SELECT concat(kind, '_cameras'), id, lane_id, camera_name, CASE WHEN kind <> 'underbody' THEN '10.0.0.1' END FROM v_cameras"""))
def _src3(t):
    path = scratch_path(t.spark, "lane-tables")
    secret = {"ip": F.lit("10.0.0.1"), "password": F.lit("secret"), "simulated_speed": F.lit(1.0)}
    t.view("controllers").withColumns(secret).write.parquet(f"{path}/controllers")
    for kind in ("driver", "anpr", "underbody"):
        t.view("cameras").filter(F.col("kind") == kind).withColumns(secret).write.parquet(f"{path}/{kind}_cameras")
    out = None
    for name, df in readers.read_lane_tables(t.spark, path).items():
        ip = F.col("ip") if "ip" in df.columns else F.lit(None).cast("string")
        label = F.col("gate_name") if name == "controllers" else F.col("camera_name")
        part = df.select(F.lit(name).alias("source"), "id", "lane_id", label.alias("name"), ip.alias("ip"))
        out = part if out is None else out.unionByName(part)
    return out


@query("src4_read_label_list", oracle=with_views("eval", body="""
SELECT concat('crops/', filename) AS rel_path, label, filename FROM v_eval WHERE line_no % 5 <> 0"""))
def _src4(t):
    path = scratch_path(t.spark, "labels")
    fields = [F.concat(F.lit("crops/"), "filename"), F.col("label")]
    line = F.when(F.col("line_no") % 5 == 0, F.concat_ws("\t", *fields, F.lit("extra"))).otherwise(F.concat_ws("\t", *fields))
    t.view("eval").select(line.alias("value")).write.text(path)
    return readers.read_eval_tsv(t.spark, path, header=False)


def _store_files(t, name, content, root):
    """One file for each event, under a name made from it, in archives."""
    named_files.register(t.spark)
    files = t.table("events").select(name.alias("name"), content.cast("binary").alias("content"))
    files.write.format("named_files").option("path", root).option("archives", "true").mode("append").save()


_ENDING = "CASE event_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '.jpg' WHEN 4 THEN '.jpeg' ELSE '.png' END"


@query("src5_list_images", oracle=f"""
SELECT concat(event_type, '_', event_id, {_ENDING}) AS filename, CAST(user_id % 23 AS BIGINT) AS length
FROM events WHERE event_id % 7 <> 3 AND event_id % 6 NOT IN (2, 4)""")
def _src5(t):
    """Images of one folder among other files and a folder below."""
    root = scratch_path(t.spark, "images")
    name = F.concat_ws("_", "event_type", F.concat(F.col("event_id").cast("string"), F.expr(_ENDING)))
    nested = F.when(F.col("event_id") % 7 == 3, F.concat(F.lit("below/"), name)).otherwise(name)
    _store_files(t, nested, F.repeat(F.lit("x"), (F.col("user_id") % 23).cast("int")), root)
    return readers.list_images(t.spark, root).select("filename", "length")


@query("src7_read_frame_log", oracle="""
SELECT concat('lane', user_id % 4 + 1) AS lane, date_trunc('second', ts)::TIMESTAMP AS started_at, CASE event_id % 3 WHEN 0 THEN 'raw' ELSE 'preview' END AS kind,
  CAST(CASE event_id % 3 WHEN 0 THEN event_id % 100000 ELSE event_id % 10000 END AS INTEGER) AS number,
  CAST(CASE WHEN event_id % 3 <> 0 THEN user_id % 40 END AS INTEGER) AS n_frames, CAST(CASE WHEN event_id % 3 <> 0 THEN event_id END AS INTEGER) AS n_rows,
  CAST(event_id % 11 AS BIGINT) AS length FROM events WHERE event_id % 10 <> 9""")
def _src7(t):
    """Recorded frames and previews of passes, among files that are neither."""
    root, text = scratch_path(t.spark, "frames"), lambda c: F.col(c).cast("string")
    number = lambda n: F.lpad((F.col("event_id") % 10**n).cast("string"), n, "0")
    folder = F.concat(F.lit("lane"), (F.col("user_id") % 4 + 1).cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("/"))
    preview = F.concat(number(4), F.lit("_"), (F.col("user_id") % 40).cast("string"), F.lit("f_"), text("event_id"), F.lit("r.jpg"))
    name = F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("notes_"), text("event_id"), F.lit(".jpg"))).when(
        F.col("event_id") % 3 == 0, F.concat(F.lit("raw/"), number(5), F.lit(".jpg"))).otherwise(preview)
    _store_files(t, F.concat(folder, name), F.repeat(F.lit("x"), (F.col("event_id") % 11).cast("int")), root)
    return readers.read_frame_log(t.spark, root).drop("path")


@query("src6_read_loop_messages", oracle=with_views("loop_lines", body=sensing._PARSED_SQL + """
SELECT lane, seq, kind FROM parsed"""))
def _src6(t):
    path = scratch_path(t.spark, "loop-lines")
    value = F.concat_ws("\t", F.col("ts").cast("string"), F.col("seq").cast("string"), F.col("line"))
    t.view("loop_lines").select("lane", value.alias("value")).write.partitionBy("lane").text(path)
    parsed = sensors.parse_loop_messages(readers.read_loop_messages(t.spark, path))
    return runtime.run_available(parsed.select("lane", "seq", "kind"), "loop-messages")


@query("x1_apply_model", oracle=with_views("patches", body="""
SELECT image_id, cell, round(list_sum(CAST(feat AS DOUBLE[])) / len(feat), 6) AS brightness FROM v_patches"""))
def _x1(t):
    def load():
        import numpy as np

        def stub(batch):
            means = [float(np.asarray(f, dtype="float64").mean()) for f in batch["feat"]]
            return batch[["image_id", "cell"]].assign(brightness=means)

        return stub

    out = apply_model(t.view("patches").select("image_id", "cell", "feat"), load, "image_id long, cell int, brightness double")
    return out.withColumn("brightness", F.round("brightness", 6))


@query("x3_consensus_text", oracle=vote_queries._oracle(vote_queries.VOTED_SQL, """
SELECT gid // 100 AS pass_id, CAST(gid % 100 AS INTEGER) AS cluster, v AS consensus FROM voted"""))
def _x3(t):
    rows = voting.cluster_reads(vote_queries.selected(t))
    ranked = rows.join(vote_queries.selected(t).select("pass_id", "seq", "frame_rank"), ["pass_id", "seq"])
    return ranked.groupBy("pass_id", "cluster").agg(voting.consensus_text("norm_text", "frame_rank").alias("consensus"))
