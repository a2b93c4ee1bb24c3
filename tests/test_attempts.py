"""Which attempt an image's reads are, with one-line and two-line shapes."""

import random

import pyarrow as pa

from gatewise.operators import voting


def test_two_line_images_spend_their_first_attempt_on_both_lines(spark):
    reads = spark.createDataFrame([(i, s, f"{i}R{s}", 0.5) for i in (1, 2, 3, 4) for s in range(8)], "pass_id long, seq long, plate_text string, confidence double")
    shapes = spark.createDataFrame([(1, False), (2, True), (3, True), (4, None), (9, True)], "pass_id long, double_line boolean")
    lines = spark.createDataFrame([(2, 0, "ka 01", 0.8), (2, 1, "ab-12", 0.6), (2, 7, "zz", 0.9), (3, 0, "only", 0.9), (1, 0, "no", 0.9), (1, 1, "no", 0.9), (9, 0, "A", 0.9), (9, 1, "B", 0.0)],
                                  "pass_id long, row int, text string, confidence double")
    got = {}
    for r in voting.attempts(reads, shapes=shapes, rows=lines).collect():
        got.setdefault(r.pass_id, {})[r.attempt] = (r.framing, r.plate_text, round(r.confidence, 6))
    plain = lambda i, shift: {a + 1 + shift: (f, f"{i}R{a}", 0.5) for a, f in enumerate(voting.FRAMINGS[: 6 - shift])}
    assert got[1] == plain(1, 0) and got[4] == plain(4, 0)
    assert got[2] == {1: (voting.TWO_LINE, "KA01AB12", 0.7)} | plain(2, 1)
    assert got[3] == plain(3, 1)  # the lower line is missing: the attempt is spent
    assert got[9] == {1: (voting.TWO_LINE, "AB", 0.9)}
    without = {(r.pass_id, r.attempt): r.framing for r in voting.attempts(reads).collect()}
    assert len(without) == 24 and without[2, 6] == voting.FRAMINGS[5]


def test_texts_laid_in_batches_as_one_by_one(spark, monkeypatch):
    """The batched alignment gives what the SQL gives, in blocks of any size."""
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("AB0é中") for _ in range(rng.randint(0, 7)))
    pairs = [(text(), text()) for _ in range(300)] + [("", "A"), ("A", ""), ("", ""), ("A\u0000B", "AB\u0000")]
    want = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").selectExpr(voting.align("a", "b")).collect()]
    assert voting.lay_over(pairs) == want
    monkeypatch.setattr(voting, "CELLS", 100)
    assert voting.lay_over(pairs) == want


def test_each_uneven_pair_of_a_batch_is_aligned_once(monkeypatch):
    seen = []
    monkeypatch.setattr(voting, "lay_over", lambda pairs: seen.extend(pairs) or ["?"] * len(pairs))
    got = voting._aligned(pa.array(["AB", "AB", None]), pa.array([["A", "XY", "A"], ["A", None], ["A"]]))
    assert got.to_pylist() == [["?", "XY", "?"], ["?", None], None] and seen == [("AB", "A")]
