"""Readers, writers and table edits on small files."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewise import schemas
from gatewise.operators import decisions, lanes, registry
from gatewise.operators.models import apply_model
from gatewise.sources import named_files, readers, writers


def test_registry_file(spark, tmp_path):
    path = tmp_path / "registry.json"
    assert readers.read_registry(spark, str(path)).count() == 0
    path.write_text("[]")
    assert readers.read_registry(spark, str(path)).count() == 0
    path.write_text("{not json")
    assert readers.read_registry(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"LicensePlate": "KA-01", "OwnerName": "A", "Classification": 1, "Notes": "", "Id": 3}], indent=2))
    assert [tuple(r) for r in readers.read_registry(spark, str(path)).collect()] == [(3, "KA-01", "A", 1, "")]


def test_first_stored_entry_wins_and_blank_never_matches(spark):
    reg = spark.createDataFrame([(1, "ka 01 ab 1234", "first", 1, "n"), (2, "KA01AB1234", "second", 2, "")], schemas.REGISTRY)
    passes = spark.createDataFrame([(1, "KA-01-AB-1234"), (2, ""), (3, "   "), (4, "ZZ9")], "id long, plate_text string")
    got = {r.id: r.owner_name for r in registry.match_registry(passes, reg).collect()}
    assert got == {1: "first", 2: None, 3: None, 4: None}
    assert sorted(r.id for r in registry.unregistered_passes(passes, reg).collect()) == [2, 3, 4]


def test_flagged_whitelist_vehicle_is_denied(spark):
    rows = [(True, 1, "own", 5, "note"), (True, 2, "own", 5, ""), (False, 2, "", 5, "x"), (False, 1, "own", 5, ""), (False, 0, "own", 5, "n"),
            (False, None, None, None, None)]
    df = spark.createDataFrame(rows, "foreign_object_detected boolean, classification int, owner_name string, registry_id long, registry_notes string")
    got = [(r.admission, r.driver_name, r.dossier_notes) for r in decisions.decide_admission(df).collect()]
    assert [g[0] for g in got] == [2, 2, 2, 0, 1, 1]
    assert got[2][1] == "Unknown" and got[2][2] == "CRITICAL ALERT: Blacklisted vehicle! x"
    assert got[3][2] == "Auto-Approved: Registered vehicle."
    assert got[5][2].endswith("Vehicle not in registry.")


def test_label_list_skips_odd_lines(spark, tmp_path):
    path = tmp_path / "list.tsv"
    path.write_text("crops/new_1.jpg\tDL1\nbroken line\na\tb\tc\ncrops/old_2.jpg\tHR2\n")
    got = [tuple(r) for r in readers.read_eval_tsv(spark, str(path), header=False).collect()]
    assert got == [("crops/new_1.jpg", "DL1", "new_1.jpg"), ("crops/old_2.jpg", "HR2", "old_2.jpg")]


def test_image_listing(spark, tmp_path):
    for name in ("a.jpg", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jpg").write_bytes(b"z")
    got = sorted((r.filename, r.length) for r in readers.list_images(spark, str(tmp_path)).collect())
    assert got == [("a.jpg", 2), ("b.png", 2)]


def test_frame_log(spark, tmp_path):
    folder = tmp_path / "lane_1_20240102_030405"
    (folder / "raw").mkdir(parents=True)
    (folder / "raw" / "00007.jpg").write_bytes(b"x")
    (folder / "0003_12f_345r.jpg").write_bytes(b"xx")
    got = {r.kind: r for r in readers.read_frame_log(spark, str(tmp_path)).collect()}
    assert (got["raw"].lane, got["raw"].number, got["raw"].n_frames) == ("lane_1", 7, None)
    assert (got["preview"].number, got["preview"].n_frames, got["preview"].n_rows) == (3, 12, 345)
    assert str(got["raw"].started_at) == "2024-01-02 03:04:05"


def test_bank_of_other_dimension_fails(spark, tmp_path):
    vectors = spark.createDataFrame([([1.0, 2.0],)], "feat array<float>")
    writers.write_bank(vectors, str(tmp_path / "bank"))
    assert readers.read_bank(spark, str(tmp_path / "bank"), dim=2).count() == 1
    with pytest.raises(Exception, match="bank vector length is not 384: 2"):
        readers.read_bank(spark, str(tmp_path / "bank")).collect()


def test_delete_rewrites_only_touched_days(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-02"), (4, "2024-01-03")], "id long, d string")
    writers.append_scan_events(df.select("id", F.col("d").cast("timestamp_ntz").alias("timestamp")), path)
    before = {p for p in (tmp_path / "events").rglob("event_date=2024-01-03/*.parquet")}
    writers.delete_scan_events(spark, path, spark.createDataFrame([(2,), (3,), (99,)], "id long"))
    assert sorted(r.id for r in readers.read_scan_events(spark, path).collect()) == [1, 4]
    assert before == {p for p in (tmp_path / "events").rglob("event_date=2024-01-03/*.parquet")}
    assert not (tmp_path / "events" / "event_date=2024-01-02").exists()


def test_replayed_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "events")
    batch = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-01")], "id long, lane_name string, d string").withColumn(
        "timestamp", F.col("d").cast("timestamp_ntz"))
    write = writers.append_batch_once(spark, path)
    write(batch, 0)
    write(batch, 0)
    assert readers.read_scan_events(spark, path).count() == 2


def test_duplicate_camera_is_an_error(spark):
    controllers = spark.createDataFrame([(1, "l1")], "id int, lane_id string")
    one = spark.createDataFrame([(1, "l1", "c")], "id int, lane_id string, camera_name string")
    assert lanes.lane_config(controllers, one, one, one).count() == 1
    with pytest.raises(Exception, match="duplicate driver camera for lane l1"):
        lanes.lane_config(controllers, one.union(one), one, one).collect()


def test_too_few_positions_fail_strictly(spark):
    df = spark.createDataFrame([("l1", "0,3"), ("l2", " ")], "lane_id string, loop_positions string")
    assert [r.usable for r in lanes.lane_positions(df).orderBy("lane_id").collect()] == [True, False]
    with pytest.raises(Exception, match="at least 2 loop positions: l2"):
        lanes.lane_positions(df, strict=True).collect()


def test_unavailable_model_yields_no_rows(spark):
    images = spark.createDataFrame([("a.jpg",)], "path string")
    assert apply_model(images, lambda: None, "path string").count() == 0


def test_serial_is_required_only_for_underbody_cameras(spark):
    cur = spark.createDataFrame([(1, "l1", "c", "s")], "id int, lane_id string, camera_name string, device_serial string")
    edits = spark.createDataFrame([(1, None, "l2", "c2", " "), (2, 1, "l1", "renamed", "s2"), (3, 9, "l9", "x", "y")],
                                  "seq long, id int, lane_id string, camera_name string, device_serial string")
    table, refused = lanes.upsert_lane_table(cur, edits, "underbody")
    assert [tuple(r) for r in table.collect()] == [(1, "l1", "renamed", "s2")]
    assert sorted((r.seq, r.reason) for r in refused.collect()) == [(1, "device_serial is required"), (3, "row no longer exists")]


def test_named_files_are_written_by_tasks(spark, tmp_path):
    named_files.register(spark)
    root = str(tmp_path / "files")
    rows = [("a.txt", b"1"), ("x/y/b.bin", b"22"), (None, b"3"), ("empty", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    for _ in range(2):  # a repeated run leaves the same files
        df.write.format("named_files").option("path", f"file:{root}").mode("append").save()
    got = {str(p.relative_to(root)): p.read_bytes() for p in (tmp_path / "files").rglob("*") if p.is_file()}
    assert got == {"a.txt": b"1", "x/y/b.bin": b"22", "empty": b""}
    listed = spark.read.format("named_files").option("path", root)
    assert sorted((r["path"].removeprefix(root), r["length"]) for r in listed.option("recursive", "true").load().collect()) == [("/a.txt", 1), ("/empty", 0), ("/x/y/b.bin", 2)]
    assert [r["path"].removeprefix(root) for r in listed.option("recursive", "false").option("endings", ".txt,.bin").load().collect()] == ["/a.txt"]
    df.limit(0).write.format("named_files").option("path", str(tmp_path / "none")).mode("append").save()
    assert (tmp_path / "none").is_dir()
    with pytest.raises(Exception, match="name leaves the folder"):
        spark.createDataFrame([("../x", b"1")], "name string, content binary").write.format("named_files").option("path", root).mode("append").save()


def test_archives_keep_every_file(spark, tmp_path, monkeypatch):
    """Packed files cost no file each, are listed like loose ones, and those of a task that failed are not seen."""
    root = tmp_path / "packed"
    rows = [(f"lane_20240102_030405/raw/{i:05d}.jpg", b"x" * (i % 4)) for i in range(300)] + [("a.jpg", None), ("_b.jpg", b"1"), ("c.txt", b"1"), (None, b"1")]
    named_files.register(spark)
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    df.write.format("named_files").option("path", str(root)).option("archives", "true").mode("append").save()
    files = [p for p in root.rglob("*") if p.is_file()]
    assert 0 < len(files) <= 3
    (root / "_archives" / ".left.zip").write_bytes(files[0].read_bytes())
    (root / "loose.jpg").write_bytes(b"12345")
    assert sorted((r.filename, r.length) for r in readers.list_images(spark, str(root)).collect()) == [("a.jpg", 0), ("loose.jpg", 5)]
    got = sorted((r.number, r.length) for r in readers.read_frame_log(spark, str(root)).collect())
    assert got == [(i, i % 4) for i in range(300)]

    monkeypatch.setattr(named_files, "ARCHIVE_FILES", 100)
    batch = pa.RecordBatch.from_pydict({"name": [n for n, _ in rows], "content": [c for _, c in rows]})
    writer = named_files.NamedFilesWriter({"path": str(tmp_path / "rolled"), "archives": "true"})
    assert (told := writer.write(iter([batch]))).files == 303 and len(told.archives) == 4


def test_strip_plan_ignores_rows_without_a_place(spark):
    from gatewise.operators import motion

    rows = [("p", i, 1216, 1.0, 30.0) for i in range(5)]
    plan = lambda r: sorted(map(tuple, motion.strip_plan(spark.createDataFrame(r, "pass_id string, seq long, frame_rows int, dx double, dy double")).collect()))
    assert plan([*rows, ("p", None, 1216, 1.0, 500.0)]) == plan(rows) != []
