"""Spelling variants: words that differ by one inserted, deleted or replaced character, found by pivotal grams.

All bigrams are ordered by how many of the dictionary's words hold them, rare ones first. A word's *prefix* is its
three rarest bigrams (and whatever ties with the third); its two *pivots* are the disjoint bigrams of the prefix
with the least total frequency, chosen by dynamic programming over positions. One edit destroys at most one of two
disjoint bigrams, so of two near words the one whose prefix ends earlier has a pivot that survives in the other
word, and there it lies in the prefix. It is enough to join pivots with prefixes.

Position limits: an edit lies either behind a surviving pivot or in front of it. In the first case both words begin
with the same characters up to and with the pivot, in the second they end with the same characters from the pivot
on; lengths differ by one at most. The join key is therefore the pivot with all that comes before it, or with all
that comes behind it, and no pair outside these limits meets. What meets is verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.common import query, table
from gatewise.session import cut_lineage

#: Letters of a word; ``RUN`` bounds the number of distinct bigrams: 90 characters, 8,100 bigrams.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX, PIVOTS = 3, 2

Gram = tuple[int, str, int]  # words that hold it, the bigram, its position


def prefix_grams(word: str, held: dict[str, int]) -> list[Gram]:
    """The word's rarest bigrams in the global order, with all that tie with the last of them."""
    grams = sorted((held[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    return [g for g in grams if g[:2] <= grams[min(PREFIX, len(grams)) - 1][:2]]


def pivot_grams(prefix: list[Gram]) -> list[Gram]:
    """Disjoint bigrams of a prefix with the least total frequency: ``best[j][i]`` is the cheapest choice of j among
    the first i by position, with or without the i-th."""
    line = sorted(prefix, key=lambda g: g[2])
    free = [sum(g[2] <= h[2] - 2 for g in line) for h in line]  # bigrams that end before this one begins
    best = [[(0, ())] * (len(line) + 1)]
    for j in range(1, PIVOTS + 1):
        row = [(float("inf"), ())]
        for i, gram in enumerate(line):
            cost, chosen = best[j - 1][free[i]]
            row.append(min(row[i], (cost + gram[0], (*chosen, gram)), key=lambda c: c[0]))
        best.append(row)
    return list(best[PIVOTS][-1][1])


def word_counts(docs: DataFrame, text: str = "text", id: str = "doc_id", least_chars: int = 6, least: int = 5, noise: int = 199) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` characters and ``least`` occurrences.

    A run whose crc32 with its document's id is divisible by ``noise`` loses one character, chosen by the same number.
    """
    lower = F.translate(docs[text], UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(docs[id].cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_chars)
    code = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (code % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(code % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least) & (F.length("word") >= least_chars))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a before b: all pairs of ``words.word`` at edit distance one, each once. Words have four characters
    or more, so that a prefix holds two disjoint bigrams."""
    spark = words.sparkSession
    grams = words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))).alias("gram"))
    held = spark.sparkContext.broadcast({r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()})  # 8,100 at most

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for word in batch.column(0).to_pylist():
                prefix = prefix_grams(word, held.value)
                pivots = {g[2] for g in pivot_grams(prefix)}
                for _, _, at in prefix:
                    for key in ("<" + word[: at + 2], ">" + word[at:]):
                        found[0].append(word)
                        found[1].append(key)
                        found[2].append(at in pivots)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.bool_())], ["word", "key", "pivot"])

    rows = words.select("word").mapInArrow(keys, "word string, key string, pivot boolean")
    rows = cut_lineage(rows.select("word", F.xxhash64("key").alias("key"), F.length("word").alias("size"), "pivot"), "gram-keys")
    pivots = rows.where("pivot").select("key", F.col("word").alias("p"), F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias("size"))
    others = rows.select("key", "size", F.col("word").alias("q"))
    met = pivots.join(others, ["key", "size"]).where((F.col("p") != F.col("q")) & (F.levenshtein("p", "q", 1) == 1))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the end; every form is more frequent than its word, so there is no
    cycle. Each round doubles the steps taken."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", ratio: int = 5, least_chars: int = 6, least: int = 5, noise: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of :func:`word_counts`.

    A word's form is its most frequent near word (ties: the smallest in code-point order), if that is ``ratio`` times
    as frequent; the root is where the forms lead. A null text has no words, a null id counts as the empty text,
    repeated rows count again, columns that are not named are not read. Texts are read whole; without a word the
    result is empty.
    """
    if least_chars < 4:
        raise ValueError("words need four characters for two disjoint bigrams among three")
    words = cut_lineage(word_counts(docs, text, id, least_chars, least, noise), "words")
    pairs = cut_lineage(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("form")).union(pairs.select("b", "a"))
    near = both.join(words.select(F.col("word").alias("form"), F.col("n").alias("form_n")), "form").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("top"))
    known = words.join(near, "word", "left")
    close = -F.col("top.m") >= ratio * F.col("n")
    known = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(close, F.col("top.form")).alias("form"), F.when(close, -F.col("top.m")).alias("form_n")), "forms")
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_pivotal_variants")
def op13(spark, sf_dir):
    """Spelling variants of all words."""
    return spelling_groups(table(spark, sf_dir, "documents"))
