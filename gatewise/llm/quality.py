"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

The last term holds every pairwise interaction <v_i, v_j> x_i x_j and costs one pass over the non-zero
features. Words go into 2**16 buckets, with their counts normalised; each statistic goes into one of
a few bins, whose bounds come from the training sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.common import Words, fresh, list_array, query, slices, table

BUCKET_BITS, RANK, BINS = 16, 8, 8
#: Labelled rows that training sees at most, and rounds over them.
TRAIN_ROWS, EPOCHS, BATCH = 12_000, 6, 128
RATE, DECAY = 0.1, 1e-5
THRESHOLD = 0.3

STATISTICS = ("words", "word_bytes", "upper", "digits", "bangs", "bars", "signs", "stops", "non_ascii", "lines", "distinct",
              "top_word", "repeats", "shingles")

_KIND = np.zeros((7, 256), np.int8)
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
_KIND[2, [33, 63]] = 1
_KIND[3, 124] = 1
_KIND[4, [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]] = 1
_KIND[5, [44, 46, 58, 59]] = 1
_KIND[6, 128:] = 1


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def features(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each hashed feature, its bucket, its value, statistics by text); a text without words has none."""
    n = len(offsets) - 1
    hashes, first = words.hashes(data, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    key, times = np.unique((owner << BUCKET_BITS) | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
    text, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    norm = np.sqrt(np.bincount(text, times.astype(float) ** 2, n))
    stats = np.zeros((n, len(STATISTICS)))
    size = np.maximum(np.diff(offsets), 1)
    per_word = np.maximum(count, 1)
    stats[:, 0] = np.log1p(count)
    stats[:, 1] = np.diff(offsets) / per_word
    for i in range(7):
        stats[:, 2 + i] = _per_text(_KIND[i][data], offsets) / size
    stats[:, 9] = _per_text(data == 10, offsets) / per_word
    stats[:, 10] = np.bincount(text, minlength=n) / per_word
    top = np.zeros(n)
    np.maximum.at(top, text, times)
    stats[:, 11] = top / per_word
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    stats[:, 12] = _per_text(same, first) / per_word
    runs = words.shingles(hashes, 3)
    inside = owner[: len(runs)] == owner[2:] if len(runs) else np.zeros(0, bool)
    seen = np.unique(mix_pair(owner[: len(runs)][inside], runs[inside]))
    stats[:, 13] = np.bincount((seen & np.uint64(0xFFFFFF)).astype(np.int64), minlength=n)[:n] / np.maximum(np.bincount(owner[: len(runs)][inside], minlength=n), 1)
    return text, bucket, times / norm[text], stats


def mix_pair(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash with the owner in the lower 24 bits."""
    return (value & ~np.uint64(0xFFFFFF)) | owner.astype(np.uint64)


class Machine:
    """Weights, and the bounds of the statistics' bins."""

    def __init__(self, n_stats: int, seed: int = 7):
        self.n_stats = n_stats
        dims = (1 << BUCKET_BITS) + n_stats * BINS
        self.bias = np.float64(0)
        self.weights = np.zeros(dims, np.float32)
        self.factors = (np.random.default_rng(seed).standard_normal((dims, RANK)) * 0.02).astype(np.float32)
        self.bounds = np.zeros((n_stats, BINS - 1))

    def rows(self, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features in the order of the texts: (index, value, first of each text)."""
        n = len(stats)
        bins = np.stack([np.searchsorted(self.bounds[i], stats[:, i], "left") for i in range(self.n_stats)], 1)
        binned = (1 << BUCKET_BITS) + np.arange(self.n_stats) * BINS + bins
        owner = np.concatenate([text, np.repeat(np.arange(n), self.n_stats)])
        order = np.argsort(owner, kind="stable")
        index = np.concatenate([bucket, binned.ravel()])[order]
        x = np.concatenate([value, np.full(n * self.n_stats, 0.5)])[order]
        return index, x, np.searchsorted(owner[order], np.arange(n))

    def raw(self, index: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every text has its statistics, so none is without features."""
        scaled = self.factors[index] * x[:, None].astype(np.float32)
        sums = np.add.reduceat(scaled, first)
        squares = np.add.reduceat((scaled * scaled).sum(1), first)
        linear = np.add.reduceat(self.weights[index] * x, first)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, scaled

    def score(self, *parts: np.ndarray) -> np.ndarray:
        index, x, first = self.rows(*parts)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, x, first)[0], -30, 30)))

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> None:
        """Logistic loss by adaptive gradient steps over rows (bucket, value, statistics)."""
        stats = np.stack([t[2] for t in texts])
        self.bounds = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = np.log(share / (1 - share))
        w_seen, v_seen = np.full(len(self.weights), 1e-6), np.full(self.factors.shape, 1e-6)
        draw = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            order = draw.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                chosen = order[lo : lo + BATCH]
                owner = np.repeat(np.arange(len(chosen)), [len(texts[i][0]) for i in chosen])
                index, x, first = self.rows(owner, np.concatenate([texts[i][0] for i in chosen]), np.concatenate([texts[i][1] for i in chosen]), stats[chosen])
                out, sums, scaled = self.raw(index, x, first)
                error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[chosen]) / len(chosen)
                each = np.repeat(error, np.diff(np.append(first, len(index))))
                spread = np.repeat(sums, np.diff(np.append(first, len(index))), axis=0)
                used, at = np.unique(index, return_inverse=True)
                gw = np.bincount(at, each * x) + DECAY * self.weights[used]
                gv = np.zeros((len(used), RANK))
                np.add.at(gv, at, (each * x)[:, None] * (spread - scaled))
                gv += DECAY * self.factors[used]
                w_seen[used] += gw**2
                v_seen[used] += gv**2
                self.weights[used] -= RATE * gw / np.sqrt(w_seen[used])
                self.factors[used] -= 0.3 * RATE * gv / np.sqrt(v_seen[used])
                self.bias -= RATE * error.sum()


def learnable(id: Column) -> Column:
    """False for the held-out fold: rows whose crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0


def _extra(docs: DataFrame, metadata: tuple[str, ...]) -> Column:
    return F.array(*[F.coalesce(F.log1p(F.greatest(docs[c], F.lit(0)).cast("double")), F.lit(-1.0)) for c in metadata]).cast("array<double>")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(n, -1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id: str = "doc_id",
          metadata: tuple[str, ...] = (), max_rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most ``max_rows`` labelled rows outside the held-out fold, the first by hash of their ids.

    Features are computed where the texts are; one task fits them, its size bounded by ``max_rows``.
    Rows without a label are not used. Without any row all texts score 0.5.
    """
    chosen = (labels.select(labels[id].alias("l_id"), labels[label].cast("double").alias("label"))
              .where(F.col("label").isNotNull() & F.col("l_id").isNotNull() & learnable(F.col("l_id")))
              .orderBy(F.xxhash64("l_id"), "l_id", "label").limit(max_rows))
    read = docs.select(docs[id].alias("l_id"), docs[text].alias("text"), _extra(docs, metadata).alias("extra"))
    sample = read.join(F.broadcast(chosen), "l_id").select(F.xxhash64("l_id").alias("order"), "text", "extra", "label")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        for batch in batches:
            extra = _matrix(batch.column(2), len(batch))
            for lo, data, offsets in slices(batch.column(1)):
                text, bucket, value, stats = features(words, data, offsets)
                n, count = len(stats), np.bincount(text, minlength=len(stats))
                stats = np.concatenate([stats, extra[lo : lo + n]], 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo : lo + n], list_array(bucket.astype(np.int32), count), list_array(value.astype(np.float32), count),
                     list_array(stats.ravel(), np.full(n, stats.shape[1])), batch.column(3)[lo : lo + n]],
                    ["order", "bucket", "value", "stats", "label"])

    rows = sample.mapInArrow(prepare, "order long, bucket array<int>, value array<float>, stats array<double>, label double")
    n_stats = len(STATISTICS) + len(metadata)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        machine = Machine(n_stats)
        pdf = pdf.sort_values("order", kind="stable")
        machine.fit(list(zip(pdf["bucket"], pdf["value"], pdf["stats"])), pdf["label"].to_numpy())
        return pd.DataFrame({"model": [pickle.dumps(machine.__dict__)]})

    fitted = rows.withColumn("all_rows", F.lit(0)).groupBy("all_rows").applyInPandas(fit, "model binary").collect()
    machine = Machine(n_stats)
    if fitted:
        machine.__dict__.update(pickle.loads(fitted[0][0]))
    else:
        machine.factors[:] = 0
    return machine


def with_score(docs: DataFrame, machine: Machine, score: str, text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the score of every whole text in a new column; a null text scores as the empty one."""
    model = docs.sparkSession.sparkContext.broadcast(machine.__dict__)  # fixed size: 2.4 MB

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words, own = Words(lower=True), Machine.__new__(Machine)
        own.__dict__.update(model.value)
        for column, extra in parts:
            more, out = _matrix(extra, len(column)), np.zeros(len(column))
            for lo, data, offsets in slices(column):
                text, bucket, value, stats = features(words, data, offsets)
                hi = lo + len(stats)
                out[lo:hi] = own.score(text, bucket, value, np.concatenate([stats, more[lo:hi]], 1))
            yield pa.array(out)

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return docs.withColumn(score, F.arrow_udf(run, "double")(docs[text], _extra(docs, metadata)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, metadata: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns they came with."""
    score = fresh(docs, "_score")[0]
    scored = with_score(docs, train(docs, labels, metadata=metadata), score, metadata=metadata)
    return scored.where(F.col(score) >= threshold).select(*docs.columns)


@query("op4_quality_machine")
def op4(spark, sf_dir):
    """Quality of every document."""
    docs, metadata = table(spark, sf_dir, "documents"), ("n_chars",)
    machine = train(docs, table(spark, sf_dir, "labels"), metadata=metadata)
    scored = with_score(docs.select("doc_id", "text", "n_chars"), machine, "score", metadata=metadata)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
