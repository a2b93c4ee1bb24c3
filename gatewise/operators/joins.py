"""Similarity, interval and as-of joins written as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.functions import plates as P


def _deletions(n: str) -> str:
    """SQL for every text left after deleting at most two characters of ``n``, one of a short text. Two
    similar texts share one of these, so equality on them finds every similar pair."""
    once = f"transform(sequence(1, length({n})), i -> concat(substring({n}, 1, i - 1), substring({n}, i + 1)))"
    twice = (
        f"flatten(transform(sequence(1, length({n})), i -> transform(filter(sequence(1, length({n})), j -> j > i), j -> "
        f"concat(substring({n}, 1, i - 1), substring({n}, i + 1, j - i - 1), substring({n}, j + 1)))))"
    )
    return f"array_distinct(concat(array({n}), {once}, if(length({n}) > {P.SHORT}, {twice}, cast(array() as array<string>))))"


def _meeting(a: str, b: str) -> str:
    """SQL for the one deletion of both texts at which a similar pair counts: ``a``, the longer, without its
    first and its last character that differs from ``b``. Two edits must be spent there, so what lies between
    is in ``b`` as well, shifted by one at most, and ``b`` has this deletion too."""
    # In a|b: the longest beginning of both, then the shortest middle of a that leaves an ending of both.
    parts = r"^(?>([^|]*)(?=[^|]*+\|\1))(?:[^|]??|[^|]([^|]*?)[^|])([^|]*+)\|\1[^|]*\3$"
    return f"regexp_replace(concat({a}, '|', {b}), r'{parts}', '$1$2$3')"


#: Texts up to this length meet on deletions, which grow with the square of the length; longer ones on segments.
LONG = 32


def _segments(n: str) -> str:
    """SQL for the three segments of ``n``, tagged with its length and their place. Of three segments two
    edits leave one as it is."""
    return (f"transform(sequence(0, 2), i -> concat_ws('|', length({n}), i, substring({n}, 1 + i * (length({n}) div 3), "
            f"if(i < 2, length({n}) div 3, length({n})))))")


def _segment_places(n: str) -> str:
    """SQL for what the segments of a text within two edits of ``n`` may be: every length near that of
    ``n``, and every shift of the segment by up to two characters."""
    size = "if(i < 2, m div 3, m - 2 * (m div 3))"
    cut = f"concat_ws('|', m, i, substring({n}, 1 + i * (m div 3) + s, {size}))"
    fits = f"1 + i * (m div 3) + s >= 1 AND i * (m div 3) + s + {size} <= length({n})"
    return (f"array_distinct(flatten(flatten(transform(sequence(length({n}) - 2, length({n}) + 2), m -> transform(sequence(0, 2), i -> "
            f"transform(filter(sequence(-2, 2), s -> {fits}), s -> {cut}))))))")


def similar_plates(left: DataFrame, right: DataFrame, text: str = "plate_text") -> DataFrame:
    """Pairs of distinct similar texts with the number of rows behind each side.

    Both sides shrink to distinct texts first, so repeated plates cost one row. Candidates meet on a
    shared deletion of at most two characters rather than on length, which keeps the groups small, long
    texts on a segment; the edit distance then decides. A pair that meets on several keys counts at one of
    them that both texts name alike, so no pairs are moved to drop the others.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        n, long = f"{name}_text", _segments if name == "left" else _segment_places
        # Lengths differ by two at most, so around the limit texts have both kinds of keys.
        none = "cast(array() as array<string>)"
        keys = (f"concat(if(length({n}) <= {LONG + 2}, {_deletions(n)}, {none}), "
                f"if(length({n}) > {LONG - 2}, {long(n)}, {none}))")
        texts = df.groupBy(P.normalize_plate(F.col(text)).alias(f"{name}_text")).agg(F.count("*").alias(f"n_{name}"))
        return texts.filter(f"{name}_text <> ''").withColumn("del", F.explode(F.expr(keys)))

    # The planner sees the texts' size, not that of their many keys, which must not be broadcast.
    met = side(left, "left").join(side(right, "right").hint("merge"), "del").filter(P.similar(F.col("left_text"), F.col("right_text")))
    longest = "greatest(length(left_text), length(right_text))"
    once = f"""CASE WHEN {longest} > {LONG + 2} THEN del = array_intersect({_segments("left_text")}, {_segment_places("right_text")})[0]
        WHEN {longest} - length(del) <> levenshtein(left_text, right_text, 2) THEN false
        WHEN length(left_text) >= length(right_text) THEN del = {_meeting("left_text", "right_text")}
        ELSE del = {_meeting("right_text", "left_text")} END"""
    return met.filter(once).select(
        "left_text", "right_text", "n_left", "n_right", F.levenshtein("left_text", "right_text").alias("distance"))
