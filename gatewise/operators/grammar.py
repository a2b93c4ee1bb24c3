"""Plate correction: candidate generation, state-prefix repair, choice of the best candidate.

Candidates come from exploding a constant list of recipes per text length; everything after that is
plain column arithmetic inside code generation plus one broadcast lookup of fixed size. Expansion
never shuffles. Choosing works on distinct texts, so a frequent plate is corrected once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.functions import plates as P

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
_TO_LETTER = ("".join(P.LETTER_SLOT_FIXES), "".join(P.LETTER_SLOT_FIXES.values()))
_TO_DIGIT = ("".join(P.DIGIT_SLOT_FIXES), "".join(P.DIGIT_SLOT_FIXES.values()))

# Generation numbers give the order candidates are produced in: raw, slot layouts, dropped
# characters, then state repairs of raw and slot texts.
SLOT_GEN, TRIM_GEN, REPAIR_GEN = 100, 10_000, 1_000_000


def _recipes_sql(n: str, open_only: bool, kinds: tuple[str, ...] = ("raw", "slot", "trim")) -> str:
    """Constant array of recipes for a text of length ``n``: a layout and the position dropped (-1 none).

    ``open_only`` leaves blank and settled texts with the raw recipe alone; other ``kinds`` are left out.
    """

    def row(gen, kind, d, l, pos, tag):
        return f"named_struct('gen', {gen}, 'kind', '{kind}', 'd', {d}, 'l', {l}, 'pos', {pos}, 'tag', '{tag}')"

    raw = row(0, "raw", 0, 0, -1, "raw")
    first = [raw] if "raw" in kinds else []
    none = f"filter(array({raw}), x -> false)"
    listed = lambda rows: f"array({', '.join(rows)})" if rows else none
    whens = []
    for size in range(8, 13):
        rows = list(first)
        for k, (tag, d, l) in enumerate(P.SLOT_LAYOUTS):
            if "slot" in kinds and 6 + d + l == size:
                rows.append(row(SLOT_GEN * (1 + k), "slot", d, l, -1, tag))
        for k, (tag, d, l) in enumerate(P.SLOT_LAYOUTS):
            if "trim" in kinds and 7 + d + l == size:
                rows += [row(TRIM_GEN + 100 * (20 * k + i), "trim", d, l, i, f"{tag}_trim{i}") for i in range(size)]
        whens.append(f"WHEN {size} THEN {listed(rows)}")
    by_length = f"CASE length({n}) {' '.join(whens)} ELSE {listed(first)} END"
    if open_only:
        return f"CASE WHEN {n} RLIKE '{P.KNOWN_FORMAT}' THEN {listed(first)} ELSE {by_length} END"
    return f"CASE WHEN {n} <> '' THEN {by_length} END"


def _one_edit_apart(a: str, b: str) -> bool:
    """Two-character texts exactly one edit apart differ in exactly one position."""
    return (a[0] != b[0]) + (a[1] != b[1]) == 1


def _repairs(prefix: str) -> list[str]:
    """State codes an unknown prefix may stand for: confusable codes in code order, else every
    code one edit away in table order."""
    options = [c + P.STATE_CHAR_OPTIONS.get(c, "") for c in prefix]
    confusable = [c for c in sorted(P.STATES) if c[0] in options[0] and c[1] in options[1]]
    return confusable or [c for c in P.STATES if _one_edit_apart(prefix, c)]


def prefix_repairs(spark: SparkSession) -> DataFrame:
    """One row per unknown two-character prefix. At most 36 x 36 rows, so it is always broadcast."""
    rows = [
        (a + b, _repairs(a + b))
        for a in _LETTERS + _DIGITS
        for b in _LETTERS + _DIGITS
        if a + b not in P.STATES
    ]
    prefixes, repairs = zip(*rows)
    table = pa.table({"prefix": pa.array(prefixes, pa.string()), "repairs": pa.array(repairs, pa.list_(pa.string()))})
    return spark.createDataFrame(table)


def _with_repairs(df: DataFrame, text: str) -> DataFrame:
    """Adds ``repairs``: state codes for an unknown prefix, null for known or too short texts."""
    x = F.col(text)
    # Known codes are absent from the lookup, so only the BH series needs to be told apart here.
    open_prefix = F.when((F.length(x) >= 4) & (F.substring(x, 3, 2) != "BH"), F.substring(x, 1, 2))
    keyed = df.withColumn("prefix", open_prefix)
    return keyed.join(F.broadcast(prefix_repairs(df.sparkSession)), "prefix", "left").drop("prefix")


def with_state_name(df: DataFrame, code: str = "state_code", out: str = "state_name") -> DataFrame:
    """Adds the name of a state code; BH is the national series, an empty code has no name."""
    names = df.sparkSession.createDataFrame(pa.table({code: list(P.STATES), out: list(P.STATES.values())}))
    # 41 fixed rows: bounded broadcast.
    named = df.join(F.broadcast(names), code, "left")
    series = F.when(F.col(code) == "BH", F.lit(P.BH_NAME)).otherwise(F.lit(""))
    return named.withColumn(out, F.coalesce(out, series))


def with_state(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """State code and name of each read; unknown prefixes stay empty."""
    return with_state_name(reads.withColumn("state_code", P.state_code(P.normalize_plate(F.col(text)))))


def state_prefix_fixes(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """One row per read and repaired text for reads whose prefix is no state code."""
    norm = reads.withColumn("_n", P.normalize_plate(F.col(text)))
    return (
        _with_repairs(norm, "_n")
        .select(*reads.columns, "_n", F.explode("repairs").alias("state_fix"))
        .withColumn("fixed_text", F.concat("state_fix", F.expr("substring(_n, 3)")))
        .drop("_n")
    )


def expand_candidates(reads: DataFrame, text: str = "plate_text", open_only: bool = False,
                      kinds: tuple[str, ...] = ("raw", "slot", "trim")) -> DataFrame:
    """One read to many candidates (gen, cand_text, cand_score, cand_tag), repeats included.

    Blank texts have no candidates. A text fitted to a layout matches the standard format and every
    repaired prefix is a known state, so only the raw text needs pattern matching.
    """
    keep = list(reads.columns)
    kind = F.col("_r.kind")
    recipes = (
        reads.withColumn("_n", P.normalize_plate(F.col(text)))
        .select(*keep, "_n", F.explode(F.expr(_recipes_sql("_n", open_only, kinds))).alias("_r"))
        .withColumn("_b", F.expr(
            "if(_r.pos < 0, _n, concat(substring(_n, 1, _r.pos), substring(_n, _r.pos + 2)))"))
        .withColumns({
            "_lp": F.expr("concat(substring(_b, 1, 2), substring(_b, 3 + _r.d, _r.l))"),
            "_dp": F.expr("concat(substring(_b, 3, _r.d), substring(_b, 3 + _r.d + _r.l))"),
        })
        .withColumns({
            "_lf": F.translate("_lp", *_TO_LETTER),
            "_df": F.translate("_dp", *_TO_DIGIT),
            # A slot changes exactly when its character is of the other kind: count those.
            "_chg": F.length(F.translate("_lp", _LETTERS, "")) + F.length(F.translate("_dp", _DIGITS, "")),
        })
        .withColumn("_f", F.when(kind == "raw", F.col("_n")).otherwise(F.expr(
            "concat(substring(_lf, 1, 2), substring(_df, 1, _r.d), substring(_lf, 3), substring(_df, _r.d + 1))")))
    )
    fits = (
        (F.translate("_lf", _LETTERS, "") == "")
        & (F.translate("_df", _DIGITS, "") == "")
        & (F.col("_f") != F.col("_n"))
        & (F.col("_chg") <= F.when(kind == "slot", 2).otherwise(1))
    )
    fixes = F.coalesce("repairs", F.array().cast("array<string>"))
    itself = F.array(F.lit(""))
    variants = (
        F.when((kind != "raw") & ~fits, F.lit(None).cast("array<string>"))
        .when((kind == "trim") & F.col("repairs").isNotNull(), fixes)
        .when(kind == "trim", itself)
        .otherwise(F.concat(itself, fixes))
    )
    # Recipes that do not fit leave with the outer explode: a filter on its output cannot be pushed
    # below the stages above, which would evaluate them twice.
    rows = (
        _with_repairs(recipes, "_f")
        .select(*keep, "_n", "_f", "_chg", F.col("_r.gen").alias("_gen"), kind.alias("_kind"),
                F.col("_r.tag").alias("_tag"), F.col("repairs").isNull().alias("_known"), F.posexplode_outer(variants).alias("_i", "_code"))
        .filter("_code IS NOT NULL")
    )
    kind, chg, own, cost = F.col("_kind"), F.col("_chg"), F.col("_code") == "", F.lit(0.05)
    fmt, repaired_fmt = F.col("_fmt"), F.col("_repaired_fmt")
    scored = (
        rows.withColumn("_repaired", F.concat("_code", F.expr("substring(_f, 3)")))
        .withColumns({
            "_fmt": F.when(kind == "raw", P.format_score(F.col("_f"))).when(
                F.col("_known"), F.lit(0.98)).otherwise(F.lit(0.9)),
            "_repaired_fmt": F.when((kind == "raw") & ~own, P.format_score(F.col("_repaired"))).otherwise(F.lit(0.98)),
        })
        .withColumn("_base", F.when(kind == "raw", fmt).otherwise(F.greatest(fmt - chg * cost, F.lit(0.0))))
    )
    score = (
        F.when((kind == "trim") & own, F.greatest(fmt - (chg + 1) * cost, F.lit(0.0)))
        .when(kind == "trim", F.greatest(F.lit(0.98) - (chg + 2) * cost, F.lit(0.0)))
        .when(own, F.col("_base"))
        .otherwise(F.greatest(F.col("_base") + (repaired_fmt - fmt) - F.lit(0.03), F.lit(0.0)))
    )
    gen = (
        F.when(kind == "trim", F.col("_gen") + F.col("_i"))
        .when(own, F.col("_gen"))
        .otherwise(F.lit(REPAIR_GEN) + F.col("_gen") + F.col("_i") - 1)
    )
    return scored.select(
        *keep,
        gen.alias("gen"),
        F.when(own, F.col("_f")).otherwise(F.col("_repaired")).alias("cand_text"),
        score.alias("cand_score"),
        F.when(own, F.col("_tag")).otherwise(F.concat("_tag", F.lit("+statefix"))).alias("cand_tag"),
    )


def expand_distinct(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """``expand_candidates`` computed once for each distinct text and joined back as one row."""
    norm = P.normalize_plate(F.col(text))
    made = ["gen", "cand_text", "cand_score", "cand_tag"]
    lists = expand_candidates(reads.select(norm.alias("_t")).filter("_t <> ''").distinct(), "_t").groupBy("_t").agg(
        F.collect_list(F.struct(*made)).alias("_l"))  # bounded by the recipes
    rows = _text_key(reads, norm, norm == "").join(lists, "_t").select(*reads.columns, F.explode("_l").alias("_e"))
    return rows.select(*reads.columns, *(F.col(f"_e.{c}").alias(c) for c in made))


def slot_fix_candidates(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """Corrections that only swap look-alike characters to fit a layout."""
    return expand_candidates(reads, text, kinds=("slot",)).filter((F.col("gen") >= SLOT_GEN) & (F.col("gen") < TRIM_GEN))


def trim_candidates(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """Corrections that drop one character to fit a layout."""
    return expand_candidates(reads, text, kinds=("trim",)).filter((F.col("gen") >= TRIM_GEN) & (F.col("gen") < REPAIR_GEN))


def state_fix_candidates(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """State repairs of the raw and slot-fixed texts."""
    return expand_candidates(reads, text, kinds=("raw", "slot")).filter(F.col("gen") >= REPAIR_GEN)


def _merged_by_text(texts: DataFrame) -> DataFrame:
    """Candidates of each distinct text ``_t``, best score per candidate text (the first of equals
    keeps its tag). One shuffle by ``_t`` serves the distinct and both groupings above it."""
    best = F.max_by(F.struct("cand_score", "cand_tag"), F.struct("cand_score", -F.col("gen")))
    return (
        expand_candidates(texts, "_t")
        .groupBy("_t", "cand_text")
        .agg(best.alias("b"), F.min("gen").alias("first_gen"))
        .select("_t", "cand_text", "first_gen", F.col("b.cand_score").alias("cand_score"), F.col("b.cand_tag").alias("cand_tag"))
    )


def _text_key(df: DataFrame, norm, skip) -> DataFrame:
    """Join key ``_t``: the normalized text, or a scattered key that matches nothing where ``skip`` holds."""
    scatter = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    return df.withColumn("_t", F.when(skip, scatter).otherwise(norm))


def merge_candidates(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """All generators merged: best score per read and text. Computed per distinct text; the per-text
    list (bounded by the recipes) is joined back as one row and exploded without a further shuffle."""
    norm = P.normalize_plate(F.col(text))
    texts = reads.select(norm.alias("_t")).filter("_t <> ''").distinct()
    lists = _merged_by_text(texts).groupBy("_t").agg(
        F.collect_list(F.struct("first_gen", "cand_text", "cand_score", "cand_tag")).alias("_l"))
    keyed = _text_key(reads, norm, norm == "")
    rows = keyed.join(lists, "_t").select(*reads.columns, F.explode("_l").alias("_e"))
    return rows.select(*reads.columns, F.col("_e.first_gen").alias("gen"), "_e.cand_text", "_e.cand_score", "_e.cand_tag")


def with_choice(df: DataFrame, text: str, chosen: str = "chosen_text", tag: str = "chosen_tag",
                score: str = "chosen_score") -> DataFrame:
    """Adds the chosen correction of ``text``: best score, then closest length, then earliest generated.

    A text in a known layout with a known state already has the top score, which no correction can
    reach, so only the remaining distinct texts are expanded.
    """
    norm = P.normalize_plate(F.col(text))
    settled = P.is_settled(norm) | (norm == "")
    texts = df.filter(~settled).select(norm.alias("_t")).distinct()
    order = F.struct("cand_score", -F.abs(F.length("cand_text") - F.length("_t")), -F.col("first_gen"))
    choices = (
        _merged_by_text(texts)
        .groupBy("_t")
        .agg(F.max_by(F.struct("cand_text", "cand_tag", "cand_score"), order).alias("_best"))
    )
    keyed = _text_key(df, norm, settled).withColumn("_norm", norm)
    return keyed.join(choices, "_t", "left").withColumns({
        chosen: F.coalesce("_best.cand_text", "_norm"),
        tag: F.coalesce("_best.cand_tag", F.lit("raw")),
        score: F.coalesce("_best.cand_score", P.format_score(F.col("_norm"))),
    }).drop("_t", "_norm", "_best")


def with_choice_in_place(df: DataFrame, text: str, keys: list[str], chosen: str = "chosen_text") -> DataFrame:
    """``with_choice`` for rows already partitioned by some of their unique ``keys``: candidates are
    grouped back onto their row, which needs no shuffle and no second pass over ``df``."""
    order = F.struct("cand_score", -F.abs(F.length("cand_text") - F.length("_norm")), -F.col("first_gen"))
    payload = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*payload).alias("_p"), P.normalize_plate(F.col(text)).alias("_norm"))
    per_text = (
        expand_candidates(packed, "_norm", open_only=True)
        .groupBy(*keys, "cand_text")
        .agg(F.max("cand_score").alias("cand_score"), F.min("gen").alias("first_gen"),
             F.first("_norm").alias("_norm"), F.first("_p").alias("_p"))
    )
    best = per_text.groupBy(*keys).agg(F.max_by("cand_text", order).alias(chosen), F.first("_p").alias("_p"))
    return best.select(*keys, *(F.col(f"_p.{c}").alias(c) for c in payload), chosen)


def choose_plate(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    return with_choice(reads, text)


def score_reads(reads: DataFrame, text: str = "plate_text") -> DataFrame:
    """Format score, length penalty and validity of each read."""
    staged = reads.withColumn("norm_text", P.normalize_plate(F.col(text)))
    n = F.col("norm_text")
    return staged.withColumns({
        "format_score": P.format_score(n), "length_penalty": P.length_penalty(n), "valid_format": P.is_valid_format(n)})


def score_candidates(reads: DataFrame, text: str = "plate_text", confidence: str = "confidence") -> DataFrame:
    """Ranking score of each candidate from read confidence, format, validity and length."""
    n = F.col("cand_text")
    valid = P.is_valid_format(n)
    score = (
        F.col(confidence) * F.lit(0.68) + F.col("cand_score") * F.lit(0.22)
        + F.when(valid, F.lit(1.0)).otherwise(F.lit(0.0)) * F.lit(0.10) - P.length_penalty(n)
    )
    return merge_candidates(reads, text).withColumns({"cand_valid": valid, "rank_score": score})
