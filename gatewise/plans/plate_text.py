"""Plate-text queries: normalisation, scoring, correction candidates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gatewise.functions import plates as P
from gatewise.operators import grammar
from gatewise.plans.registry import query
from gatewise.plans.tables import with_views

CODES_SQL = "codes(code, ord, name) AS (VALUES " + ", ".join(
    f"('{c}', {i}, '{n}')" for i, (c, n) in enumerate(P.STATES.items())) + ")"
NORM_SQL = "upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
STD_SQL = "(regexp_matches({0}, '^[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{1,3}}[0-9]{{1,4}}$') OR regexp_matches({0}, '^[0-9]{{2}}BH[0-9]{{4}}[A-Z]{{1,2}}$'))"
KNOWN_SQL = "(substr({0}, 3, 2) = 'BH' OR substr({0}, 1, 2) IN (SELECT code FROM codes))"


def std(x):
    return STD_SQL.format(x)


def known(x):
    return KNOWN_SQL.format(x)


def fmt(x):
    return (f"(CASE WHEN {std(x)} THEN CASE WHEN {known(x)} THEN 0.98E0 ELSE 0.9E0 END WHEN length({x}) BETWEEN 6 AND 12"
            f" AND regexp_matches({x}, '[A-Z]') AND regexp_matches({x}, '[0-9]') THEN 0.45E0 ELSE 0.0E0 END)")


def penalty(x):
    return (f"(CASE WHEN length({x}) = 0 THEN 0.05E0 WHEN {std(x)} OR length({x}) BETWEEN 8 AND 11 THEN 0.0E0"
            f" WHEN length({x}) BETWEEN 6 AND 13 THEN 0.02E0 ELSE 0.05E0 END)")


def valid(x):
    return f"(length({x}) BETWEEN 6 AND 12 AND {std(x)})"


# Candidate generation as joins over distinct texts: layouts, dropped positions, repaired prefixes.
# ``texts(n)`` must be defined before it; ends with cands(n, gen, text, score, tag).
CANDIDATES_SQL = f"""
layouts(tag, k, d, l) AS (VALUES ('indian_8', 0, 1, 1), ('indian_9a', 1, 1, 2), ('indian_9b', 2, 2, 1),
  ('indian_10a', 3, 1, 3), ('indian_10b', 4, 2, 2), ('indian_11', 5, 2, 3)),
opts(ch, alt) AS (VALUES ('0','O'),('0','D'),('0','Q'),('1','I'),('1','L'),('2','Z'),('4','A'),('5','S'),('6','G'),('8','B'),
  ('O','D'),('O','Q'),('O','C'),('D','O'),('Q','O'),('C','G'),('C','O'),('G','C'),('I','L'),('L','I'),('V','Y'),('Y','V')),
recipes AS (
  SELECT n, (1 + k) * 100 AS gen, 'slot' AS kind, tag, d, l, n AS b FROM texts, layouts WHERE length(n) = 6 + d + l
  UNION ALL
  SELECT n, 10000 + 100 * (20 * k + p.i), 'trim', concat(tag, '_trim', p.i), d, l, concat(substr(n, 1, p.i), substr(n, p.i + 2))
  FROM texts, layouts, range(12) p(i) WHERE length(n) = 7 + d + l AND p.i < length(n)),
fitted AS (
  SELECT *, translate(substr(b, 1, 2) || substr(b, 3 + d, l), '0124568', 'OIZASGB') AS lf,
    translate(substr(b, 3, d) || substr(b, 3 + d + l), 'OQDILZSBGT', '0001125867') AS df,
    substr(b, 1, 2) || substr(b, 3 + d, l) AS lraw, substr(b, 3, d) || substr(b, 3 + d + l) AS draw FROM recipes),
slots AS (
  SELECT n, gen, kind, tag, substr(lf, 1, 2) || substr(df, 1, d) || substr(lf, 3) || substr(df, d + 1) AS f,
    length(regexp_replace(lraw, '[A-Z]', '', 'g')) + length(regexp_replace(draw, '[0-9]', '', 'g')) AS chg
  FROM fitted WHERE regexp_matches(lf, '^[A-Z]*$') AND regexp_matches(df, '^[0-9]*$')),
base AS (
  SELECT n, 0 AS gen, 'raw' AS kind, 'raw' AS tag, n AS f, 0 AS chg FROM texts WHERE n <> ''
  UNION ALL SELECT * FROM slots WHERE (kind = 'slot' AND chg <= 2 AND f <> n) OR (kind = 'trim' AND chg <= 1)),
unknown AS (SELECT DISTINCT f, substr(f, 1, 2) AS pre FROM base WHERE length(f) >= 4 AND NOT {known('f')}),
prefixes AS (SELECT DISTINCT pre FROM unknown),
confusable AS (
  SELECT pre, code, row_number() OVER (PARTITION BY pre ORDER BY code) - 1 AS i FROM prefixes, codes
  WHERE (substr(pre, 1, 1) = substr(code, 1, 1) OR (substr(pre, 1, 1), substr(code, 1, 1)) IN (SELECT (ch, alt) FROM opts))
    AND (substr(pre, 2, 1) = substr(code, 2, 1) OR (substr(pre, 2, 1), substr(code, 2, 1)) IN (SELECT (ch, alt) FROM opts))),
fixes AS (
  SELECT * FROM confusable UNION ALL
  SELECT pre, code, row_number() OVER (PARTITION BY pre ORDER BY ord) - 1 FROM prefixes, codes
  WHERE levenshtein(pre, code) = 1 AND pre NOT IN (SELECT pre FROM confusable)),
repaired AS (
  SELECT b.*, x.code || substr(b.f, 3) AS g, x.i FROM base b JOIN unknown u ON u.f = b.f JOIN fixes x ON x.pre = u.pre),
cands AS (
  SELECT n, gen, f AS text, greatest({fmt('f')} - chg * 0.05E0, 0E0) AS score, tag FROM base WHERE kind <> 'trim'
  UNION ALL SELECT n, gen, f, greatest({fmt('f')} - (chg + 1) * 0.05E0, 0E0), tag FROM base WHERE kind = 'trim' AND {known('f')}
  UNION ALL SELECT n, gen + i, g, greatest({fmt('g')} - (chg + 2) * 0.05E0, 0E0), tag || '+statefix' FROM repaired WHERE kind = 'trim'
  UNION ALL SELECT n, 1000000 + gen + i, g,
    greatest(greatest({fmt('f')} - chg * 0.05E0, 0E0) + ({fmt('g')} - {fmt('f')}) - 0.03E0, 0E0), tag || '+statefix'
  FROM repaired WHERE kind <> 'trim')"""
MERGED_SQL = CANDIDATES_SQL + """,
merged AS (
  SELECT n, text, score, tag, first_gen FROM (
    SELECT *, row_number() OVER (PARTITION BY n, text ORDER BY score DESC, gen) AS r, min(gen) OVER (PARTITION BY n, text) AS first_gen
    FROM cands) q WHERE r = 1),
chosen AS (
  SELECT n, text, tag, score FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, abs(length(text) - length(n)), first_gen) AS r FROM merged) q WHERE r = 1)"""
_OWN_NAMES = ("layouts opts recipes fitted slots base unknown prefixes confusable fixes repaired cands merged chosen texts").split()


def second_copy(sql: str, suffix: str) -> str:
    """The same expressions under suffixed names, for a second use inside one statement."""
    return re.sub(r"\b(" + "|".join(_OWN_NAMES) + r")\b(?!\.)(?=[^']*(?:'[^']*'[^']*)*$)", rf"\g<1>{suffix}", sql)


READS_SQL = f"""
{CODES_SQL},
reads AS (SELECT *, {NORM_SQL.format('plate_text')} AS n FROM v_plate_reads),
texts AS (SELECT DISTINCT n FROM reads)"""


def reads_oracle(body: str, *more: str) -> str:
    return with_views("plate_reads", body=",\n".join([READS_SQL, *more]) + "\n" + body)


@query("p1_normalize_plate", oracle=with_views("registry", body=f"""
SELECT id, {NORM_SQL.format('license_plate')} AS norm_text FROM v_registry"""))
def _p1(t):
    return t.view("registry").select("id", P.normalize_plate(F.col("license_plate")).alias("norm_text"))


@query("p2_registry_key", oracle=with_views("registry", body=r"""
SELECT id, upper(regexp_replace(license_plate || 'é٣', '[^\p{L}\p{Nd}]', '', 'g')) AS reg_key FROM v_registry"""))
def _p2(t):
    return t.view("registry").select("id", P.registry_key(F.concat("license_plate", F.lit("é٣"))).alias("reg_key"))


@query("p3_p4_p5_score_reads", oracle=reads_oracle(f"""
SELECT seq, n AS norm_text, {fmt('n')} AS format_score, {penalty('n')} AS length_penalty, {valid('n')} AS valid_format FROM reads"""))
def _p3(t):
    return grammar.score_reads(t.view("plate_reads")).select(
        "seq", "norm_text", "format_score", "length_penalty", "valid_format")


def _candidate_oracle(where: str) -> str:
    return reads_oracle(f"""
SELECT r.seq, CAST(c.gen AS INTEGER) AS gen, c.text AS cand_text, round(c.score, 9) AS cand_score, c.tag AS cand_tag
FROM reads r JOIN cands c ON c.n = r.n WHERE {where}""", CANDIDATES_SQL)


def _candidate_rows(df):
    return df.select("seq", "gen", "cand_text", F.round("cand_score", 9).alias("cand_score"), "cand_tag")


@query("p6_slot_fix_candidates", oracle=_candidate_oracle("gen >= 100 AND gen < 10000"))
def _p6(t):
    return _candidate_rows(grammar.slot_fix_candidates(t.view("plate_reads")))


@query("p7_trim_candidates", oracle=_candidate_oracle("gen >= 10000 AND gen < 1000000"))
def _p7(t):
    return _candidate_rows(grammar.trim_candidates(t.view("plate_reads")))


@query("p8_state_fix_candidates", oracle=_candidate_oracle("gen >= 1000000"))
def _p8(t):
    return _candidate_rows(grammar.state_fix_candidates(t.view("plate_reads")))


@query("x2_expand_candidates", oracle=_candidate_oracle("true"))
def _x2(t):
    return _candidate_rows(grammar.expand_distinct(t.view("plate_reads")))


@query("u1_merge_candidates", oracle=reads_oracle("""
SELECT r.seq, CAST(m.first_gen AS INTEGER) AS gen, m.text AS cand_text, round(m.score, 9) AS cand_score, m.tag AS cand_tag
FROM reads r JOIN merged m ON m.n = r.n""", MERGED_SQL))
def _u1(t):
    return _candidate_rows(grammar.merge_candidates(t.view("plate_reads")))


@query("p9_choose_plate", oracle=reads_oracle("""
SELECT r.seq, r.plate_text, coalesce(c.text, r.n) AS chosen_text, coalesce(c.tag, 'raw') AS chosen_tag,
  round(coalesce(c.score, 0E0), 9) AS chosen_score FROM reads r LEFT JOIN chosen c ON c.n = r.n""", MERGED_SQL))
def _p9(t):
    return grammar.choose_plate(t.view("plate_reads")).select(
        "seq", "plate_text", "chosen_text", "chosen_tag", F.round("chosen_score", 9).alias("chosen_score"))


@query("p10_score_candidates", oracle=reads_oracle(f"""
SELECT r.seq, m.text AS cand_text, {valid('m.text')} AS cand_valid,
  round(r.confidence * 0.68E0 + m.score * 0.22E0 + (CASE WHEN {valid('m.text')} THEN 1E0 ELSE 0E0 END) * 0.1E0 - {penalty('m.text')}, 9)
  AS rank_score FROM reads r JOIN merged m ON m.n = r.n""", MERGED_SQL))
def _p10(t):
    return grammar.score_candidates(t.view("plate_reads")).select(
        "seq", "cand_text", "cand_valid", F.round("rank_score", 9).alias("rank_score"))


@query("j8_with_state", oracle=reads_oracle(f"""
SELECT seq, CASE WHEN substr(n, 3, 2) = 'BH' THEN 'BH' ELSE coalesce(c.code, '') END AS state_code,
  CASE WHEN substr(n, 3, 2) = 'BH' THEN 'Bharat Series' ELSE coalesce(c.name, '') END AS state_name
FROM reads LEFT JOIN codes c ON c.code = substr(n, 1, 2)"""))
def _j8(t):
    return grammar.with_state(t.view("plate_reads")).select("seq", "state_code", "state_name")


@query("j11_state_prefix_fixes", oracle=reads_oracle("""
SELECT r.seq, x.code AS state_fix, x.code || substr(r.n, 3) AS fixed_text FROM reads r
JOIN unknown u ON u.f = r.n JOIN fixes x ON x.pre = u.pre""", CANDIDATES_SQL))
def _j11(t):
    return grammar.state_prefix_fixes(t.view("plate_reads")).select("seq", "state_fix", "fixed_text")
