"""Phrases that occur together more often than their parts would by chance, mined set-wise.

R(k) is the relation of all occurrences of frequent phrases of k words: one row per document with the places
and the phrases there, in order. Each length takes the same steps:

1. merge-join R(k-1) with itself at adjacent places of a piece: the phrase at p and the phrase at p + 1 share all
   but one word and make one of k words;
2. group by the two phrases and count, combined in each task first; groups under the threshold go;
3. semi-join: only occurrences of groups that stay are written as R(k).

A phrase cannot be frequent unless its two parts are, so no frequent phrase is lost. The semi-join uses a Bloom
filter of the frequent groups, sized by their number up to a fixed bound: what it lets through wrongly is
counted and dropped in step 2 of the next length, so counts and results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.llm.common import _LOWER, _BASE, _BYTE, _Powers, bloom_has, bloom_words, list_array, mix, query, slices, table, window_hash
from gatewise.session import cut_lineage

#: Bytes that end a piece, and those that part words inside one.
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x09, 0x20]] = True

#: Fewest and most words of a frequency filter (64 bits each): 64 kB and 32 MB.
_FILTER_BITS = (13, 22)
#: Occurrences that a task groups at a time, and documents of R that it opens at a time.
GROUP_ROWS, OPEN_ROWS = 1 << 19, 256

_U = np.uint64
_LEFT, _RIGHT = _U(0x9E6C63D0876A9A47), _U(0xC2B2AE3D27D4EB4F)


def joined_id(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Id of the phrase whose all-but-last words are ``left`` and all-but-first ``right``."""
    return mix(mix(left.view(_U) * _LEFT) + right.view(_U) * _RIGHT)


def occurrences(powers: _Powers, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> tuple:
    """Words of a run of texts: (id, place, start, end, first word of each text). Places of a piece are
    consecutive, and one is left out between two pieces."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_GAPS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    broken = np.zeros(n + 1, np.int64)
    np.cumsum(_ENDS[data], out=broken[1:])
    piece = broken[starts]
    place = np.arange(len(starts))
    if len(starts):
        new = np.zeros(len(starts), np.int64)
        new[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
        place += np.cumsum(new)
    ids = window_hash(_BYTE[_LOWER[data]], starts, ends, powers)
    return mix(ids + salt[owner]), place, starts, ends, first


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased words at these places, as strings."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[at]])).cast(pa.string())


def _salts(langs: pa.Array) -> np.ndarray:
    """A number of each language, so that equal words of two languages are two words."""
    coded = langs.dictionary_encode()
    each = np.array([int.from_bytes(blake2b(v.encode(), digest_size=8).digest()) for v in coded.dictionary.to_pylist()] + [0], _U)
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, a) of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_BASE)
        for batch in batches:
            salts = _salts(batch.column(0))
            for lo, data, offsets in slices(batch.column(1)):
                ids, _, starts, ends, first = occurrences(powers, data, offsets, salts[lo : lo + len(offsets) - 1])
                if not len(ids):
                    continue
                _, at, a = np.unique(ids, return_index=True, return_counts=True)
                owner = np.searchsorted(first, at, "right") - 1 + lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), _spans(data, starts[at], ends[at]), pa.array(a.astype(np.int64))], ["lang", "word", "a"])

    return docs.mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def _word_ids(words: DataFrame) -> DataFrame:
    """``words`` with the id that :func:`occurrences` gives each word."""

    def ident(lang: pa.Array, word: pa.Array) -> pa.Array:
        powers, salts, out = _Powers(_BASE), _salts(lang), np.zeros(len(word), _U)
        for lo, data, offsets in slices(word):
            hi = lo + len(offsets) - 1
            out[lo:hi] = mix(window_hash(_BYTE[data], offsets[:-1], offsets[1:], powers) + salts[lo:hi])
        return pa.array(out.view(np.int64))

    ident.__annotations__ = {"lang": pa.Array, "word": pa.Array, "return": pa.Array}
    return words.withColumn("id", F.arrow_udf(ident, "long")("lang", "word"))


def _filter(spark, groups: DataFrame):
    """Broadcast Bloom words of the ids of ``groups``: 16 bits a group, 32 MB at most."""
    n = groups.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / 4)), *_FILTER_BITS))
    return spark.sparkContext.broadcast(bloom_words(groups, "id", bits))


def _frequent_words(docs: DataFrame, kept) -> DataFrame:
    """R(1) after its semi-join: per document ``gap`` (to the place before) and ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_BASE)
        for batch in batches:
            salts = _salts(batch.column(0))
            for lo, data, offsets in slices(batch.column(1)):
                ids, place, _, _, first = occurrences(powers, data, offsets, salts[lo : lo + len(offsets) - 1])
                stay = np.flatnonzero(bloom_has(kept.value, ids))
                size = np.diff(np.searchsorted(stay, first))
                yield pa.RecordBatch.from_arrays(
                    [list_array(np.diff(place[stay], prepend=0).astype(np.int32), size), list_array(ids[stay].view(np.int64), size)], ["gap", "id"])

    return docs.mapInArrow(run, "gap array<int>, id array<long>")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gap, id, list offsets) of a few documents of R at a time."""
    for batch in batches:
        for lo in range(0, len(batch), OPEN_ROWS):
            gaps, ids = batch.column(0).slice(lo, OPEN_ROWS), batch.column(1).slice(lo, OPEN_ROWS)
            size = pc.list_value_length(gaps).to_numpy(zero_copy_only=False).astype(np.int64)
            yield (gaps.flatten().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))


def _adjacent(gap: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Entries that stand one place after the entry before, in the same document."""
    follows = gap == 1
    follows[offsets[:-1][offsets[:-1] < len(gap)]] = False
    return np.flatnonzero(follows)


def _pairs(relation: DataFrame, tell, schema: str) -> DataFrame:
    """What ``tell(left, right)`` gives for the adjacent pairs of ``relation``, about ``GROUP_ROWS`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights, n = [], [], 0
        for gap, ids, offsets in _opened(batches):
            at = _adjacent(gap, offsets)
            lefts.append(ids[at - 1])
            rights.append(ids[at])
            n += len(at)
            if n >= GROUP_ROWS:
                yield tell(np.concatenate(lefts), np.concatenate(rights))
                lefts, rights, n = [], [], 0
                pa.default_memory_pool().release_unused()
        if n:
            yield tell(np.concatenate(lefts), np.concatenate(rights))

    return relation.select("gap", "id").mapInArrow(run, schema)


def _group_counts(relation: DataFrame, least: int) -> DataFrame:
    """(left, right, a) of the frequent phrases one word longer than those of ``relation``.

    Most pairs are rare and would only be moved to be dropped. So pairs are first counted by 40 bits of their id; what
    reaches ``least`` there, a pair or several that share these bits, is then counted by itself.
    """

    def buckets(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        found, a = np.unique(joined_id(left, right) >> _U(24), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(a.astype(np.int64))], ["id", "a"])

    counted = _pairs(relation, buckets, "id long, a long").groupBy("id").agg(F.sum("a").alias("a"))
    # The filter looks at bits 40 and up too, so the 40 bits are laid over the word twice.
    spread = F.shiftleft("id", 24).bitwiseXOR(F.col("id")).alias("id")
    likely = _filter(relation.sparkSession, cut_lineage(counted.where(F.col("a") >= least).select(spread), "buckets"))

    def groups(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        bucket = joined_id(left, right) >> _U(24)
        stay = bloom_has(likely.value, (bucket << _U(24)) ^ bucket)
        return pa.RecordBatch.from_arrays([pa.array(left[stay]), pa.array(right[stay])], ["left", "right"])

    rows = _pairs(relation, groups, "left long, right long")  # Spark combines them in each task
    return rows.groupBy("left", "right").agg(F.count("*").alias("a")).where(F.col("a") >= least)


def _extended(relation: DataFrame, kept) -> DataFrame:
    """R(k) from R(k-1): the adjacent pairs whose group is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gap, ids, offsets in _opened(batches):
            at = _adjacent(gap, offsets)
            made = joined_id(ids[at - 1], ids[at])
            stay = bloom_has(kept.value, made)
            at, made = at[stay], made[stay]
            place = np.cumsum(gap)  # places run on through a batch; only differences inside a document count
            first = np.searchsorted(at, offsets)
            size = np.diff(first)
            rows = size > 0
            diff = np.diff(place[at], prepend=0)
            yield pa.RecordBatch.from_arrays([list_array(diff.astype(np.int32), size[rows]), list_array(made.view(np.int64), size[rows])], ["gap", "id"])

    return relation.select("gap", "id").mapInArrow(run, "gap array<int>, id array<long>")


def _with_id(groups: DataFrame) -> DataFrame:
    def ident(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(joined_id(left.to_numpy(zero_copy_only=False), right.to_numpy(zero_copy_only=False)).view(np.int64))

    ident.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return groups.withColumn("id", F.arrow_udf(ident, "long")("left", "right"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """([phrases of 1, 2, ... words], (lang, n)).

    Phrases: id, lang, phrase, last (word), a, and what is known of its parts: ``heads`` and ``tails`` are the
    counts of its first and last 1, 2, ... words; ``left`` and ``right`` are the ids of the two phrases it is made of.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text")).where(F.length("text") > 0)
    words = cut_lineage(_word_counts(read), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    common = _word_ids(words.where(F.col("a") >= least))
    none = F.array().cast("array<long>")
    level = cut_lineage(common.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"),
                                      F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right")), "phrases-1")
    relation = cut_lineage(_frequent_words(read, _filter(spark, level)), "occurrences-1")
    levels = [level]
    for k in range(2, longest + 1):
        groups = cut_lineage(_with_id(_group_counts(relation, least)), f"groups-{k}")
        head = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("h"), F.col("a").alias("ha"), F.col("heads").alias("hs"))
        tail = level.select(F.col("id").alias("right"), "last", F.col("a").alias("ta"), F.col("tails").alias("ts"))
        level = cut_lineage(groups.join(head, "left").join(tail, "right").select(
            "id", "lang", F.concat_ws(" ", "h", "last").alias("phrase"), "last", "a", F.concat("hs", F.array("ha")).alias("heads"),
            F.concat("ts", F.array("ta")).alias("tails"), "left", "right"), f"phrases-{k}")
        levels.append(level)
        if k < longest:
            relation = cut_lineage(_extended(relation, _filter(spark, groups)), f"occurrences-{k}")
    return levels, totals


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)) in 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a * 1000) * wide(n), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase must occur ``least`` times. Its lowest-scoring cut counts, ties to the shortest first part. A phrase
    inside a longer candidate with at least ``share`` percent of its occurrences goes; with ``share`` 100, equal
    counts, it is enough to look one word further, as counts only fall with length. Rank: score, then a, both
    descending, then the phrase by its bytes.

    A null text has no words, a null language is ``und``. Ids are not read, so null ids and repeated rows count like
    others. Long texts are read in slices; without a frequent phrase the result is empty.
    """
    if share < 100:
        raise ValueError("share under 100 would need every longer candidate of a phrase")
    levels, totals = frequent_phrases(docs, least, longest, text, lang)
    found = []
    for k in range(2, longest + 1):
        cuts = F.array(*[
            F.struct(_score(F.col("a"), F.col("n"), F.col("heads")[j - 1], F.col("tails")[k - j - 1]).alias("score"), F.lit(j).alias("j"),
                     F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r"))
            for j in range(1, k)])
        here = levels[k - 1].join(F.broadcast(totals), "lang")
        if k < longest:
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("b")).groupBy("id").agg(F.max("b").alias("b"))
            here = here.join(longer, "id", "left").where(F.coalesce(F.col("b") * 100 < F.col("a") * share, F.lit(True)))
        found.append(here.select("lang", "phrase", "a", "n", F.array_min(cuts).alias("cut")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS no FROM d),
w AS (SELECT doc, lang, no, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS i FROM p),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4, lead(w, 4) OVER s AS w5 FROM w WINDOW s AS (PARTITION BY doc, no ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS (SELECT lang, [w1] AS p, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, p[i:j] AS p, max(a) AS b FROM f, range(1, 5) x(i), range(2, 6) y(j) WHERE len(p) > 2 AND j > i AND j <= len(p) AND j - i + 1 < len(p) GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN inner_ USING (lang, p) WHERE len(f.p) >= 2 AND NOT coalesce(100 * b >= 100 * a, false)),
s AS (SELECT c.lang, c.p, c.a, l.a AS l, r.a AS r, n.n, k, CAST((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM c JOIN n USING (lang), range(1, 5) z(k) JOIN f l ON true JOIN f r ON true
  WHERE k < len(c.p) AND l.lang = c.lang AND r.lang = c.lang AND l.p = c.p[:k] AND r.p = c.p[k + 1:]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank,
  array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM m)
SELECT * FROM o WHERE rank <= 2000"""


@query("op12_setm_phrases", oracle=ORACLE)
def op12(spark, sf_dir):
    """Phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))
