"""Hand-derived expectations of the published formulas. Plates, groups and reads below are fixed values."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gatewise.functions import plates as P
from gatewise.operators import grammar, reports, voting
from gatewise.sources import writers


@pytest.fixture(scope="module")
def dumped_events(spark):
    rows = [(i, f"2026-09-12 08:{m}:00", a) for i, m, a in ((1, 10, 1), (2, 20, 1), (3, 30, 2), (4, 40, 1))]
    df = spark.createDataFrame(rows, "id long, timestamp string, admission int")
    return df.select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "admission",
                     (F.col("admission") == 2).alias("foreign_object_detected"))


def test_kpis_of_four_events(dumped_events):
    assert reports.kpi_totals(dumped_events).first() == Row(total=4, approved=0, denied=1, threats=1)
    split = reports.safety_split(dumped_events).first()
    assert (split.cleared, split.cleared_share) == (3, 0.75)
    hours = {r.hour: r.n_events for r in reports.hourly_distribution(dumped_events).collect()}
    assert len(hours) == 24 and hours.pop(8) == 4 and not any(hours.values())


def test_empty_history_has_zero_shares(dumped_events):
    split = reports.safety_split(dumped_events.limit(0)).first()
    assert (split.total, split.cleared_share, split.threat_share) == (0, 0.0, 0.0)


def test_choose_plate(spark):
    texts = ["DL5CY3199", "22BH0432C", "KL65G4218", "OL5CY3199", "", "ABCDEFGH"]
    got = {r.plate_text: (r.chosen_text, r.chosen_tag, round(r.chosen_score, 9)) for r in grammar.choose_plate(
        spark.createDataFrame([(t,) for t in texts], "plate_text string")).collect()}
    for t in texts[:3]:
        assert got[t] == (t, "raw", 0.98)
    assert got["OL5CY3199"] == ("DL5CY3199", "raw+statefix", 0.95)
    assert got[""][:2] == ("", "raw") and got["ABCDEFGH"][:2] == ("ABCDEFGH", "raw")


def test_in_place_choice_equals_joined_choice(spark):
    texts = ["OL5CY3199", "D111CT0820", "HR3BAC6737", "MH12AB1234A", "DL05AB99B9", "KL65C1241", "22BH0432C", "", "0L1O"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, plate_text string").repartition("k")
    joined = {r.k: r.chosen_text for r in grammar.with_choice(df, "plate_text").collect()}
    placed = {r.k: r.chosen_text for r in grammar.with_choice_in_place(df, "plate_text", ["k"]).collect()}
    assert joined == placed


def reads(spark, groups):
    rows = [
        (g, i, has, text, conf, quality, float(sharp), det)
        for g, members in enumerate(groups) for i, (has, det, text, conf, quality, sharp) in enumerate(members)
    ]
    return spark.createDataFrame(
        rows, "pass_id int, frame_rank int, has_bbox boolean, plate_text string, confidence double, quality double, "
        "sharpness double, det_conf double").withColumn("seq", F.col("frame_rank").cast("long"))


VOTES = [
    [(True, 0.9, "DL5CY3199", 0.95, 0.8, 150)] * 7 + [(True, 0.7, "DL5CY3099", 0.85, 0.7, 140)] * 3,
    [(True, 0.9, "HR26FT2618", 0.9, 0.8, 150)] * 4 + [(True, 0.6, "BR26FT2618", 0.6, 0.5, 100)] * 3
    + [(True, 0.5, "HR26FI2618", 0.5, 0.4, 90)] * 3,
    [(True, 0.9, "DL5CY3199", 0.9, 0.8, 150)] * 5 + [(True, 0.8, "DL5CY31999", 0.8, 0.7, 140)] * 5,
    [(False, 0.0, "", 0.0, 0.0, 0)] * 5,
]


def test_vote_groups(spark):
    got = {r.pass_id: r for r in voting.vote_plate(reads(spark, VOTES)).collect()}
    expected = {
        0: ("DL5CY3199", 0.92, 10, 1, True, 14.5945),
        1: ("HR26FT2618", 0.69, 10, 1, True, 14.3410),
        2: ("DL5CY3199", 0.85, 10, 1, True, 14.5330),
        3: ("", 0.0, 0, 0, False, 0.0),
    }
    for g, (text, conf, votes, clusters, valid, score) in expected.items():
        r = got[g]
        assert (r.plate_text, round(r.plate_confidence, 4), r.votes, r.n_clusters, r.plate_text_valid, round(r.score, 4)) == (
            text, conf, votes, clusters, valid, score)


def test_six_votes_do_not_confirm(spark):
    r = voting.vote_plate(reads(spark, [VOTES[0][:6]])).first()
    assert r.votes == 6 and not r.plate_text_valid and not r.min_candidates_met


def test_vote_does_not_depend_on_partitioning(spark):
    df = reads(spark, VOTES)
    one = sorted(voting.vote_plate(df.coalesce(1)).collect())
    many = sorted(voting.vote_plate(df.repartition(13, "sharpness", "frame_rank")).collect())
    assert one == many


def test_consensus_groups(spark):
    groups = [["DL5CY3199"] * 3, ["DL5CY3199", "DL5CY31999", "DL5CY3199"], ["HR26FT2618", "HR26FT2618", "BR26FT2618"]]
    df = reads(spark, [[(True, 0.9, t, 0.9, 0.8, 100) for t in g] for g in groups])
    got = {r.pass_id: r.plate_text for r in voting.vote_plate(df).collect()}
    assert got == {0: "DL5CY3199", 1: "DL5CY3199", 2: "HR26FT2618"}


@pytest.mark.parametrize("reference,other,expected", [
    ("DL5CY3199", "DL5CY31999", "DL5CY3199"),
    ("ABC", "AC", "A C"),
    ("ABCD", "BCD", " BCD"),
    ("ABC", "XABC", "ABC"),
    ("ABC", "", "   "),
])
def test_alignment(spark, reference, other, expected):
    laid = spark.createDataFrame([(reference, other)], "a string, b string").selectExpr(voting.align("a", "b"))
    assert laid.first()[0] == expected


def test_align_reads_keeps_every_pair(spark):
    pairs = [("ABC", "AC"), ("ABC", "ABD"), ("ABC", "AC"), ("AB", "XABX")]
    got = sorted(tuple(r) for r in voting.align_reads(spark.createDataFrame(pairs, "reference string, other string")).collect())
    laid = {("ABC", "AC"): "A C", ("ABC", "ABD"): "ABD", ("AB", "XABX"): "AB"}
    assert got == sorted((r, o, laid[r, o]) for r, o in pairs)


# The six wrong reads of the published evaluation; the other 247 of 253 are right.
WRONG = [("old", "KL35J4199", "KL35JK5699"), ("old", "AP09BM5751", "WP09B1751"), ("old", "KL65G4218", "KL65G421"),
         ("old", "AP39BD0606", "AP39BD0666"), ("old", "MP48BD1069", "MP43BD1069"), ("new", "HR55AQ6878", "HR55A06878")]


def test_report_accuracy(spark):
    rows = [(f"{p}_w{i}.jpg", label, text) for i, (p, label, text) in enumerate(WRONG)]
    rows += [(f"new_{i}.jpg", f"DL{i:02d}A1000", f"DL{i:02d}A1000") for i in range(82)]
    rows += [(f"old_{i}.jpg", f"HR{i:03d}", f"HR{i:03d}") for i in range(165)]
    df = spark.createDataFrame(rows, "filename string, label string, text string")
    labels, texts = df.select("filename", "label"), df.select("filename", "text")
    got = {r.source: (r.n_correct, r.n_total) for r in reports.accuracy(reports.join_eval(labels, texts)).collect()}
    assert got == {"overall": (247, 253), "new": (82, 83), "old": (165, 170)}


def test_normalizers(spark):
    df = spark.createDataFrame([("ka-01 ab 1234",), ("ı1ſ2é",), (None,), ("--",)], "t string")
    out = df.select("t", P.normalize_plate(F.col("t")).alias("n"), P.registry_key(F.col("t")).alias("k"), P.lookup_key(F.col("t")).alias("look"))
    rows = [tuple(r) for r in out.collect()]
    assert rows[0][1:3] == ("KA01AB1234", "KA01AB1234")
    assert rows[1][1] == "12"  # no letter appears through case mapping
    assert rows[2][1] == "" and rows[3][2] == ""
    again = out.select((P.normalize_plate(F.col("n")) == F.col("n")).alias("same")).collect()
    assert all(r.same for r in again)


def test_report_lines(spark):
    df = spark.createDataFrame([("a.jpg", "L", "", 0.5, "original:raw", False)], "filename string, label string, text string, confidence double, variant string, correct boolean")
    assert tuple(writers.eval_report_rows(df).first()) == ("a.jpg", "L", "", "0.5000", "original:raw", "False")
