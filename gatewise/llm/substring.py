"""Substring dedup by seed and extend.

Every window of ``length`` words has an anchor: the smallest hash among its runs of ``seed`` words, the first of equal
ones. Winnowing thus gives two documents that repeat a passage of that length an anchor in common, at the same place of
it, while a document has few anchors. An occurrence of an anchor carries the words on either side that its windows reach.

Occurrences of one anchor meet the one of the smallest id, and the match is extended word by word to the left and to the
right. The windows inside the match repeat that document. Windows that reach beyond it may still repeat another one: their
occurrence goes on with all others that part from the first document at the same place with the same word. Each such
round fixes one more word of a group, so there are as many rounds as words around an anchor at most, and no pairs of
occurrences are formed. Matches that overlap or touch in a document unite to its maximal repeats.

Texts that equal a text of a smaller id are repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.common import SLICE_ROWS, Words, bloom_has, bloom_words, fresh, list_array, mark_filter, mark_key, query, slices, split_rows, table
from gatewise.session import cut_lineage

LENGTH, SEED_WORDS = 13, 5
#: log2 of the 8-byte words of the seeds' Bloom filter; one too small for its keys only lets more rows pass.
SEED_FILTER = 21
#: A group with more than this share of all occurrences is split, so at most this many groups are.
SHARES = 4096


class _Anchors:
    """Occurrences of anchors in a slice of texts, words counted over the slice.

    ``pos`` is an occurrence's first word and ``owner`` its text; its windows begin ``low`` to ``high`` words before it.
    """

    def __init__(self, words: Words, data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
        self.words, self.first = words.hashes(data, offsets)
        runs, wide, count = words.shingles(self.words, seed), length - seed + 1, np.diff(self.first)
        starts = np.flatnonzero(np.arange(len(self.words)) + length <= np.repeat(self.first[1:], count))
        owner = np.repeat(np.arange(len(count)), np.maximum(count - length + 1, 0))
        least, at = runs[starts], starts.copy()
        for i in range(1, wide):
            other = runs[starts + i]
            less = other < least
            least[less], at[less] = other[less], starts[less] + i
        # The place of the anchor never moves back from one window to the next: its windows follow each other.
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        last = np.concatenate([new[1:], [len(at)]]).astype(np.int64)[: len(new)] - 1
        self.pos, self.owner, self.anchor = at[new], owner[new], least[new]
        self.high, self.low = self.pos - starts[new], self.pos - starts[last]

    def around(self, use: np.ndarray, length: int, seed: int) -> tuple[pa.ListArray, pa.ListArray]:
        """Hashes of the words left and right of the chosen occurrences, nearest first, as far as their windows reach."""
        short = (self.words >> np.uint64(32)).astype(np.uint32).view(np.int32)

        def lists(begin: np.ndarray, size: np.ndarray, step: int) -> pa.ListArray:
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            return list_array(short[np.repeat(begin, size) + step * nth], size)

        pos = self.pos[use]
        return lists(pos - 1, self.high[use], -1), lists(pos + seed, length - seed - self.low[use], 1)


def _hashed(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(docs[id].cast("long").alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"), docs[text].alias("text"))


def _shared(hashed: DataFrame, length: int, seed: int) -> DataFrame:
    """Anchors (a) that different texts have in common."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=False)
        for batch in batches:
            for lo, data, offsets in slices(batch.column(1)):
                found = _Anchors(words, data, offsets, length, seed)
                yield pa.RecordBatch.from_arrays([pa.array(found.anchor.view(np.int64)), batch.column(0).take(pa.array(lo + found.owner))], ["a", "h"])

    each = hashed.select("h", "text").mapInArrow(anchors, "a long, h long")
    return each.groupBy("a").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("a")


_ROW = "g long, id long, h long, pos int, low int, high int, left array<int>, right array<int>"


def _occurrences(hashed: DataFrame, length: int, seed: int) -> DataFrame:
    """Occurrences of shared anchors: group g (the anchor), document, place, windows and the words around."""
    filter_ = hashed.sparkSession.sparkContext.broadcast(bloom_words(_shared(hashed, length, seed), "a", SEED_FILTER))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=False)
        for batch in batches:
            for lo, data, offsets in slices(batch.column(2)):
                found = _Anchors(words, data, offsets, length, seed)
                use = np.flatnonzero(bloom_has(filter_.value, found.anchor)) if len(found.anchor) else np.zeros(0, np.int64)
                if not len(use):
                    continue
                rows = pa.array(lo + found.owner[use])
                places = (found.pos[use] - found.first[found.owner[use]], found.low[use], found.high[use])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.anchor[use].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                     *(pa.array(x.astype(np.int32)) for x in places), *found.around(use, length, seed)],
                    ["g", "id", "h", "pos", "low", "high", "left", "right"])

    return hashed.where("id IS NOT NULL").mapInArrow(occurrences, _ROW)


def _extend(rows: DataFrame, reach: int) -> DataFrame:
    """Matches of ``rows`` with the first document of their group, and what goes on to the next round.

    A match (kind 0) has its windows in ``low`` .. ``high``. Windows that reach further to the left than the match (kind
    1), or only to the right (kind 2), go on with their new group; so do those of the first document's other occurrences,
    which may be what a later document repeats. ``reach`` is the words of a window outside its anchor.
    """
    groups = cut_lineage(rows.groupBy("g").agg(F.min(F.struct("id", "left", "right")).alias("m"), F.max("id").alias("x"), F.count("*").alias("n"))
                         .where("x > m.id").drop("x"), "first")
    total = groups.agg(F.sum("n")).first()[0] or 0
    # SHARES groups at most can hold a larger share. Their rows are dealt over parts, each with a copy of the first.
    hot = F.broadcast(groups.where(F.col("n") * SHARES > total).select("g", F.expr(f"cast(n * {SHARES} div {max(total, 1)} + 1 as int)").alias("parts")))
    dealt = rows.join(hot, "g", "left").withColumn("part", F.expr("coalesce(pmod(xxhash64(id, pos), parts), 0)")).drop("parts")
    first = groups.select("g", "m").join(hot, "g", "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1) - 1L)"))).drop("parts")
    same = "coalesce(nullif(array_position(zip_with({0}, m.{0}, (x, y) -> x <=> y), false), 0) - 1, size({0}))"
    met = (dealt.join(first, ["g", "part"]).where("id >= m.id")
           .select("g", "id", "h", F.expr("id > m.id").alias("later"), "pos", "low", "high", "left", "right", F.expr(same.format("left")).cast("int").alias("l"), F.expr(same.format("right")).cast("int").alias("r")))
    kinds = [("0", "0L", f"if(later, greatest(low, {reach} - r), high + 1)", "least(high, l)", "cast(null as array<int>)", "cast(null as array<int>)"),
             ("1", "xxhash64(g, 1, l, get(left, l))", "greatest(low, l + 1)", "high", "left", f"slice(right, 1, {reach} - greatest(low, l + 1))"),
             ("2", "xxhash64(g, 2, r, get(right, r))", "low", f"least(high, l, {reach - 1} - r)", f"slice(left, 1, greatest(0, least(high, l, {reach - 1} - r)))", "right")]
    options = ", ".join(f"named_struct('kind', {k}, 'g', {g}, 'low', {a}, 'high', {b}, 'left', if({a} <= {b}, {x}, null), 'right', if({a} <= {b}, {y}, null))"
                        for k, g, a, b, x, y in kinds)
    return met.select("id", "h", "pos", F.inline(F.expr(f"filter(array({options}), o -> o.low <= o.high)")))


def repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """(id, h, whole, spans) for documents with words to remove, h being the text's hash.

    ``spans`` are (first word, word after the last) of matches of ``length`` words or more with a document of a smaller id;
    ``whole`` tells that the entire text is one. A null id is neither smaller nor larger than any; ids are whole numbers.
    """
    hashed, reach = _hashed(docs, text, id), length - seed
    rows, matches = _occurrences(hashed, length, seed), []  # read twice: hashing texts again is less than a table of them
    for _ in range(2 * reach + 1):
        out = cut_lineage(_extend(rows, reach), "matches")
        matches.append(out.where("kind = 0").select("id", "h", F.expr("pos - high").alias("from"), F.expr(f"pos - low + {length}").alias("to")))
        rows = out.where("kind > 0").drop("kind")
        if rows.isEmpty():
            break
    spans = matches[0]
    for more in matches[1:]:
        spans = spans.union(more)
    spans = spans.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))  # at most a text's words

    copies = hashed.groupBy("h").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select("h", "m")
    whole = hashed.select("id", "h").join(copies, "h").where("id > m").select("id", "h", F.lit(True).alias("whole")).distinct()
    return spans.join(whole, ["id", "h"], "full").select("id", "h", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")


def _maximal(spans) -> list[tuple[int, int]]:
    """Sorted spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for span in spans or ():
        if out and span["from"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], span["to"])
        else:
            out.append((span["from"], span["to"]))
    return out


def _kept(text: bytes, whole: bool, spans, length: int) -> tuple[list[bytes], int]:
    """Words that stay, and the number there was. bytes.split() parts at exactly the six separators."""
    words = text.split()
    if whole and len(words) >= length:
        return [], len(words)
    kept, at = [], 0
    for a, b in _maximal(spans):
        kept += words[at:a]
        at = b
    return kept + words[at:], len(words)


def digest(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row.

    Documents without marks are digested where they are read; only those that may have some move to meet
    them. A null or empty text has no words and the digest of nothing; rows with a null id lose nothing;
    repeated rows are each returned; an empty table gives no rows; further columns are ignored. Ids are whole numbers.
    """
    marks = cut_lineage(repeats(docs, text, id, length), "marks")
    words = mark_filter(docs, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, len(whole_batch), SLICE_ROWS):
                batch = whole_batch.slice(lo, SLICE_ROWS)
                met = "spans" in batch.schema.names  # has met the marks
                later = np.zeros(len(batch), bool) if met else bloom_has(words.value, batch.column("key").to_numpy(zero_copy_only=False))
                whole, spans = (batch.column(c).to_pylist() if met else [None] * len(batch) for c in ("whole", "spans"))
                rows, texts = [], []
                for i, value in enumerate(batch.column("text").to_pylist()):
                    texts.append(value if later[i] else None)
                    if later[i]:
                        rows.append((None, None, None))
                        continue
                    kept, n = _kept((value or "").encode(), bool(whole[i]), spans[i], length)
                    rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                made = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *made, pa.array(texts, pa.string()), pa.array(later)],
                                                 ["_id", "n_words", "n_removed", "kept_sha256", "text", "maybe"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id].dataType.simpleString()
    schema = f"_id {kind}, n_words long, n_removed long, kept_sha256 string, text string, maybe boolean"
    read = docs.select(docs[id].alias("_id"), docs[text].alias("text"), mark_key(docs, text, id).alias("key"))
    first = cut_lineage(read.mapInArrow(run, schema), "digests")
    names = [F.col("_id").alias(id), "n_words", "n_removed", "kept_sha256"]
    late = first.where("maybe").select("_id", "text", F.col("_id").cast("long").alias("j_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("j_h"))
    met = late.join(marks, (late["j_id"] == marks["id"]) & (late["j_h"] == marks["h"]), "left")
    second = met.select("_id", "text", "whole", "spans").mapInArrow(run, schema)
    return first.where("NOT maybe").select(*names).union(second.select(*names))


def strip_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated words taken out of their texts, and its own columns only.

    Only texts that lose words change: what they keep is joined by single spaces. A text that loses every
    word goes, with its row. Null and empty texts and rows with a null id stay as they are, repeated rows are each
    returned, an empty table stays empty, and columns of any name keep their values. Ids are whole numbers.
    """
    marks = cut_lineage(repeats(docs, text, id, length), "marks")
    flag, hash_ = fresh(docs, "_maybe", "_h")
    rows = split_rows(docs, marks, text, id, [docs[c] for c in docs.columns], flag)
    late = rows.where(F.col(flag)).withColumn(hash_, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    marks = marks.select(F.col("id").alias("m_id"), F.col("h").alias("m_h"), F.col("whole").alias("m_whole"), F.col("spans").alias("m_spans"))
    met = late.join(marks, (late[id].cast("long") == marks["m_id"]) & (late[hash_] == marks["m_h"]), "left")

    def cut(texts: pa.Array, whole: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, w, s in zip(texts.to_pylist(), whole.to_pylist(), spans.to_pylist()):
            kept, n = _kept((t or "").encode(), bool(w), s, length)
            out.append(t if n == len(kept) else b" ".join(kept).decode() if kept else None)
        return pa.array(out, pa.string())

    cut.__annotations__ = {"texts": pa.Array, "whole": pa.Array, "spans": pa.Array, "return": pa.Array}
    left = F.arrow_udf(cut, "string")(F.col(text), F.col("m_whole"), F.col("m_spans"))
    changed = met.withColumn(hash_, F.col(text).isNull()).withColumn(text, left).where(F.col(text).isNotNull() | F.col(hash_))
    return rows.where(~F.col(flag)).select(*docs.columns).union(changed.select(*docs.columns))


@query("op9_substring_dedup")
def op9(spark, sf_dir):
    """Words of every document that remain when repeats of 13 words go."""
    return digest(table(spark, sf_dir, "documents"))
