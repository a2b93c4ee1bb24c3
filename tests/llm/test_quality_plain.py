"""The quality machine's inputs, folds and scores against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import words as plain_words
from gatewise.llm import quality
from gatewise.llm.common import Words, small_batches

TEXTS = ["", "one", "One one TWO two two!", "a|b #c;\n\nd?? 12 a a a", "é ü 漢字 é é ü", "x y z x y z x y z w"]


def plain_statistics(text):
    data, w = text.encode(), plain_words(text, True)
    size, per_word, count = max(len(data), 1), max(len(w), 1), Counter(w)
    share = lambda chars: sum(b in chars for b in data) / size
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return [math.log1p(len(w)), len(data) / per_word, share(range(65, 91)), share(range(48, 58)), share(b"!?"), share(b"|"),
            share(b"#$%&*+<=>@\\^_`{}~"), share(b",.:;"), share(range(128, 256)), data.count(b"\n") / per_word, len(count) / per_word,
            max(count.values(), default=0) / per_word, sum(a == b for a, b in zip(w, w[1:])) / per_word, len(set(runs)) / max(len(runs), 1)]


def inputs(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    return quality.features(Words(lower=True), np.frombuffer(b"".join(data), np.uint8), offsets)


def test_statistics_match_plain_python():
    got = inputs(TEXTS)[3]
    for text, row in zip(TEXTS, got):
        assert row == pytest.approx(plain_statistics(text)), text


def test_word_values_are_normalised_counts():
    text, bucket, value, _ = inputs(TEXTS)
    for i, t in enumerate(TEXTS):
        counts = sorted(Counter(plain_words(t, True)).values())
        norm = math.sqrt(sum(c * c for c in counts))
        assert sorted(value[text == i]) == pytest.approx([c / norm for c in counts])
        assert len(set(bucket[text == i])) == len(counts)


def test_score_is_the_sum_over_all_pairs():
    parts = inputs(TEXTS)
    machine = quality.Machine(len(quality.STATISTICS))
    draw = np.random.default_rng(1)
    machine.weights[:] = draw.normal(size=len(machine.weights)).astype(np.float32)
    machine.factors[:] = draw.normal(size=machine.factors.shape).astype(np.float32)
    machine.bounds = np.sort(draw.random((machine.n_stats, quality.BINS - 1)), axis=1)
    machine.bias = 0.25
    for i, got in enumerate(machine.score(*parts)):
        mine = parts[0] == i
        features = [(int(b), float(v)) for b, v in zip(parts[1][mine], parts[2][mine])]
        for s, x in enumerate(parts[3][i]):
            place = sum(x > b for b in machine.bounds[s])
            features.append(((1 << quality.BUCKET_BITS) + s * quality.BINS + place, 0.5))
        total = machine.bias + sum(float(machine.weights[f]) * x for f, x in features)
        for a in range(len(features)):
            for b in range(a):
                (f, x), (g, y) = features[a], features[b]
                total += float(machine.factors[f].astype(float) @ machine.factors[g].astype(float)) * x * y
        assert got == pytest.approx(1 / (1 + math.exp(-min(max(total, -30), 30))), rel=1e-3, abs=1e-6)


def test_op4_folds_and_predictions(spark, docs, rows, tmp_path):
    known = {r[0]: int(r[0] % 3 == 0) for r in rows if r[0] is not None}
    scores = []
    for turned in (False, True):
        folder = tmp_path / str(turned)
        docs.write.parquet(str(folder / "documents.parquet"))
        labels = [(i, 1 - y if turned and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in known.items()]
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
        got = quality.op4(spark, str(folder)).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
        assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
        scores.append(sorted((str(r["doc_id"]), r["score"]) for r in got))
    assert [s for _, s in scores[0]] == pytest.approx([s for _, s in scores[1]])  # held-out labels change nothing


def test_scores_of_an_empty_table(spark, no_docs, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.keep_good(no_docs, labels).count() == 0
    assert quality.with_score(no_docs, quality.train(no_docs, labels), "score_").count() == 0


def test_small_batches_are_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
