"""Shared pieces: reading, word hashing over Arrow buffers, fixed-size Bloom words and connected components.

Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]``; UTF-8 never uses those bytes inside a
character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text hashed at a time; a longer text is its own slice.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 512

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use yet, however it is spelt there."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def keep_columns(df: DataFrame, **renamed: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; clashing extra columns fall away here."""
    return df.select(*[df[c].alias(n) for n, c in renamed.items()])


_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of whole texts hold this many rows at most: their buffers lie outside the JVM's heap, and several
    operators in a row leave little room beside it. The session's own choice is restored, and a smaller one stays."""
    before = int(spark.conf.get(_BATCH_KEY))
    spark.conf.set(_BATCH_KEY, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, str(before))


# ---- word hashing ---------------------------------------------------------------------------------

_U = np.uint64
#: Odd multipliers, fixed so that hashes agree between runs.
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE_BYTES + 1024)
            with np.errstate(over="ignore"):
                one = np.ones(1, _U)
                self.up = np.multiply.accumulate(np.concatenate([one, np.full(size - 1, self.base, _U)]))
                self.down = np.multiply.accumulate(np.concatenate([one, np.full(size - 1, self.inverse, _U)]))
        return self.up, self.down


def window_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every window; equal windows get equal hashes anywhere."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _STEP)


class Words:
    """The words of a run of texts: ``hash`` of each word and ``first[i]:first[i + 1]`` those of text i."""

    def __init__(self, lower: bool):
        self.lower = lower
        self.bytes, self.words = _Powers(_BASE), _Powers(_STEP | _U(1))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # a word never runs from one text into the next
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = self.spans(data, offsets)
        coded = _BYTE[_LOWER[data] if self.lower else data]
        return window_hash(coded, starts, ends, self.bytes), first

    def shingles(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of k words, at the position of its first word."""
        starts = np.arange(max(0, len(words) - k + 1))
        return window_hash(words, starts, starts + k, self.words)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows holding about ``limit`` bytes; null is the empty text."""
    for base in range(0, len(column), SLICE_ROWS):
        part = column.slice(base, SLICE_ROWS).cast(pa.large_string()).fill_null("")
        _, offs, data = part.buffers()
        offsets = np.frombuffer(offs, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            hi = min(hi, len(part))
            yield base + lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on and would hold it through the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees by its own rules
        pass


def list_array(values: np.ndarray, lengths) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


# ---- a Bloom filter of fixed size -------------------------------------------------------------------


def bloom_words(keys: DataFrame, column: str, log2_words: int) -> np.ndarray:
    """A Bloom filter over a column of 64-bit hashes: each key sets three bits of one 64-bit word.

    Its size is the parameter's, whatever the number of keys: more keys only let more rows pass."""
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({column}, {s}) & 63 as int))" for s in _BLOOM_SHIFTS))
    word = F.col(column).bitwiseAND((1 << log2_words) - 1)
    rows = keys.groupBy(word.alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()
    out = np.zeros(1 << log2_words, np.int64)
    for batch in rows.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


_BLOOM_SHIFTS = (40, 46, 52)


def bloom_has(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; none that is in it fails."""
    found, keys = words.view(_U)[keys.view(_U) & _U(len(words) - 1)], keys.view(_U)
    out = np.ones(len(keys), bool)
    for s in _BLOOM_SHIFTS:
        out &= (found >> ((keys >> _U(s)) & _U(63))) & _U(1) == 1
    return out


#: log2 of the words of the filter that tells which rows have marks.
MARK_FILTER = 19


def mark_key(docs: DataFrame, text: str, id: str) -> Column:
    return F.xxhash64(docs[id].cast("long"), F.xxhash64(F.coalesce(docs[text], F.lit(""))))


def mark_filter(docs: DataFrame, marks: DataFrame):
    """Broadcast words of the filter over the keys of ``marks``: 4 MB."""
    keys = marks.select(F.xxhash64(F.col("id").cast("long"), "h").alias("k"))
    return docs.sparkSession.sparkContext.broadcast(bloom_words(keys, "k", MARK_FILTER))


def split_rows(docs: DataFrame, marks: DataFrame, text: str, id: str, columns: list, flag: str) -> DataFrame:
    """``columns`` of docs and ``flag``: whether one of the ``marks`` (id, h) may belong to the row, h being the
    text's hash. Rows without one need not move to meet the marks."""
    words = mark_filter(docs, marks)

    def maybe(keys: pa.Array) -> pa.Array:
        return pa.array(bloom_has(words.value, keys.to_numpy(zero_copy_only=False)))

    maybe.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return docs.select(*columns, F.arrow_udf(maybe, "boolean")(mark_key(docs, text, id)).alias(flag))


# ---- connected components ---------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (u, v); the component is its smallest node.

    Alternating large and small stars; each round is a few shuffles of narrow rows and a written table.
    """
    u, v = F.col("u"), F.col("v")
    flat = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now, before = cut_lineage(flat, "edges"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(u.alias("node"), v.alias("component")).union(now.select(v, v).distinct())
        before = state
        both = now.union(now.select(v, u))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v, F.col("m")).union(least.select("u", "m"))
        now = cut_lineage(small.toDF("u", "v").distinct(), "edges")
