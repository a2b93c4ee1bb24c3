"""Vote queries: frame selection, clustering, consensus and the voted plate."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import evidence, joins, voting
from gatewise.plans.plate_text import (
    CODES_SQL, MERGED_SQL, NORM_SQL, READS_SQL, fmt, known, penalty, second_copy, valid,
)
from gatewise.plans.registry import query
from gatewise.plans.tables import with_views

SELECTED_SQL = f"""
{CODES_SQL},
sel AS (SELECT * FROM (SELECT *, {NORM_SQL.format('plate_text')} AS n,
  row_number() OVER (PARTITION BY pass_id ORDER BY quality DESC, seq DESC) AS frame_rank FROM v_plate_reads) q WHERE frame_rank <= 10)"""


def similar(a, b):
    return (f"(abs(length({a}) - length({b})) <= 2 AND levenshtein({a}, {b}) <= "
            f"CASE WHEN greatest(length({a}), length({b})) <= 7 THEN 1 ELSE 2 END)")


# Leader clustering of ordered(gid, k, n), k = 1.. per group: led(gid, leaders).
LEADERS_SQL = f"""
lead AS (
  SELECT DISTINCT gid, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS leaders FROM ordered
  UNION ALL
  SELECT l.gid, o.k, CASE WHEN len(list_filter(l.leaders, lambda x: {similar('x', 'o.n')})) > 0 THEN l.leaders
    ELSE list_append(l.leaders, o.n) END FROM lead l JOIN ordered o ON o.gid = l.gid AND o.k = l.k + 1),
led AS (SELECT gid, arg_max(leaders, k) AS leaders FROM lead GROUP BY gid),
assigned AS (
  SELECT o.*, list_position(list_transform(d.leaders, lambda x: {similar('x', 'o.n')}), true) - 1 AS c, d.leaders
  FROM ordered o JOIN led d ON d.gid = o.gid)"""
# Consensus of grp(gid, ord, n): voted(gid, v, size) before correction.
CONSENSUS_SQL = """
lens AS (SELECT gid, length(n) AS len, count(*) AS c, min(ord) AS f FROM grp GROUP BY gid, length(n)),
modal AS (SELECT gid, len FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY c DESC, f) AS r FROM lens) q WHERE r = 1),
refs AS (SELECT g.gid, m.len, arg_min(g.n, g.ord) AS ref FROM grp g JOIN modal m ON m.gid = g.gid AND m.len = length(g.n) GROUP BY ALL),
pairs AS (SELECT DISTINCT r.ref AS r, g.n AS o FROM grp g JOIN refs r ON r.gid = g.gid WHERE length(g.n) <> r.len),
dp AS (
  SELECT r, o, CAST(0 AS BIGINT) AS i, [range(length(o) + 1)] AS mat FROM pairs
  UNION ALL
  SELECT r, o, i + 1, list_append(mat, list_reduce(range(1, length(o) + 1), lambda acc, j: list_append(acc,
    least(mat[i + 1][j + 1] + 1, acc[-1] + 1, mat[i + 1][j] + CASE WHEN substr(r, i + 1, 1) <> substr(o, j, 1) THEN 1 ELSE 0 END)),
    [i + 1])) FROM dp WHERE i < length(r)),
tb AS (
  SELECT r, o, mat, CAST(length(r) AS BIGINT) AS ri, CAST(length(o) AS BIGINT) AS oj, '' AS tail FROM dp WHERE i = length(r)
  UNION ALL
  SELECT r, o, mat, CASE WHEN step = 'left' THEN ri ELSE ri - 1 END, CASE WHEN step = 'up' THEN oj ELSE oj - 1 END,
    CASE step WHEN 'diag' THEN substr(o, oj, 1) || tail WHEN 'up' THEN ' ' || tail ELSE tail END
  FROM (SELECT *, CASE WHEN mat[ri + 1][oj + 1] = mat[ri][oj] + CASE WHEN substr(r, ri, 1) <> substr(o, oj, 1) THEN 1 ELSE 0 END THEN 'diag'
      WHEN mat[ri + 1][oj + 1] = mat[ri][oj + 1] + 1 THEN 'up' ELSE 'left' END AS step
    FROM tb WHERE ri > 0 AND oj > 0) s),
laid AS (SELECT r, o, repeat(' ', ri) || tail AS a FROM tb WHERE ri = 0 OR oj = 0),
al AS (SELECT g.gid, g.ord, r.ref, r.len, coalesce(x.a, g.n) AS a FROM grp g JOIN refs r ON r.gid = g.gid
  LEFT JOIN laid x ON x.r = r.ref AND x.o = g.n),
spots AS (SELECT gid, ord, ref, a, unnest(range(1, len + 1)) AS p FROM al),
votes AS (SELECT gid, p, substr(a, p, 1) AS ch, count(*) AS n, min(ord) AS f FROM spots WHERE substr(a, p, 1) <> ' ' GROUP BY ALL),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid, p ORDER BY n DESC, f) AS r FROM votes) q WHERE r = 1),
chars AS (SELECT s.gid, s.p, coalesce(t.ch, substr(s.ref, s.p, 1)) AS ch, coalesce(t.n, 0) AS n
  FROM (SELECT DISTINCT gid, ref, p FROM spots) s LEFT JOIN tops t ON t.gid = s.gid AND t.p = s.p),
voted AS (SELECT c.gid, string_agg(c.ch, '' ORDER BY c.p) AS v, (SELECT count(*) FROM grp g WHERE g.gid = c.gid) AS size
  FROM chars c GROUP BY c.gid)"""
CLUSTER_SQL = SELECTED_SQL + """,
ordered AS (SELECT pass_id AS gid, row_number() OVER (PARTITION BY pass_id ORDER BY frame_rank) AS k, n, seq, confidence,
  quality, sharpness FROM sel WHERE has_bbox AND n <> ''),""" + LEADERS_SQL
VOTED_SQL = CLUSTER_SQL + """,
grp AS (SELECT gid * 100 + c AS gid, k AS ord, n FROM assigned),""" + CONSENSUS_SQL


def _oracle(sql: str, body: str) -> str:
    return with_views("plate_reads", body=sql + "\n" + body, recursive=True)


def selected(t):
    return voting.best_plate_frames(t.view("plate_reads"))


@query("w1_best_plate_frames", oracle=_oracle(SELECTED_SQL, "SELECT pass_id, seq, CAST(frame_rank AS INTEGER) AS frame_rank FROM sel"))
def _w1(t):
    return selected(t).select("pass_id", "seq", "frame_rank")


@query("w3_cluster_reads", oracle=_oracle(CLUSTER_SQL, """
SELECT gid AS pass_id, seq, n AS norm_text, CAST(c AS INTEGER) AS cluster, leaders[c + 1] AS representative FROM assigned"""))
def _w3(t):
    return voting.cluster_reads(selected(t))


@query("a4_cluster_stats", oracle=_oracle(CLUSTER_SQL, """
SELECT gid AS pass_id, CAST(c AS INTEGER) AS cluster, CAST(count(*) AS INTEGER) AS votes, round(avg(confidence), 9) AS avg_confidence,
  round(avg(quality), 9) AS avg_quality FROM assigned GROUP BY gid, c"""))
def _a4(t):
    return voting.cluster_stats(voting.read_clusters(selected(t))).select(
        "pass_id", "cluster", "votes", F.round("avg_confidence", 9).alias("avg_confidence"),
        F.round("avg_quality", 9).alias("avg_quality"))


@query("a5_modal_length", oracle=_oracle(VOTED_SQL, """
SELECT gid // 100 AS pass_id, CAST(gid % 100 AS INTEGER) AS cluster, CAST(len AS INTEGER) AS modal_length FROM modal"""))
def _a5(t):
    return voting.with_modal_length(voting.read_clusters(selected(t))).select("pass_id", "cluster", "modal_length")


@query("a6_char_votes", oracle=_oracle(VOTED_SQL, """
SELECT gid // 100 AS pass_id, CAST(gid % 100 AS INTEGER) AS cluster, CAST(p AS INTEGER) AS pos, ch AS char, CAST(n AS INTEGER) AS n_votes FROM chars"""))
def _a6(t):
    return voting.char_votes(voting.read_clusters(selected(t))).select("pass_id", "cluster", "pos", "char", "n_votes")


@query("w5_align_reads", oracle=_oracle(VOTED_SQL, """
SELECT DISTINCT r.ref AS reference, g.n AS other, coalesce(x.a, g.n) AS aligned FROM grp g JOIN refs r ON r.gid = g.gid
LEFT JOIN laid x ON x.r = r.ref AND x.o = g.n"""))
def _w5(t):
    rows = voting.with_modal_length(voting.read_clusters(selected(t))).withColumn(
        "reference", F.expr("filter(members, m -> length(m.n) = modal_length)[0].n"))
    pairs = rows.select("reference", F.explode("members").alias("m")).select("reference", F.col("m.n").alias("other")).distinct()
    return voting.align_reads(pairs)


_BEST_SQL = VOTED_SQL + f""",
texts AS (SELECT DISTINCT v AS n FROM voted WHERE size > 1),{MERGED_SQL},
cons AS (SELECT w.gid, CASE WHEN size > 1 THEN coalesce(h.text, w.v) ELSE w.v END AS consensus FROM voted w LEFT JOIN chosen h ON h.n = w.v),
stats AS (SELECT gid AS pass_id, c, gid * 100 + c AS gid, count(*) AS votes, avg(confidence) AS ac, avg(quality) AS aq FROM assigned GROUP BY ALL),
bests AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid, c ORDER BY confidence DESC, quality DESC,
  least(sharpness / 200E0, 1E0) DESC, {fmt('n')} DESC, k) AS r FROM assigned) q WHERE r = 1),
scored AS (SELECT s.*, k.consensus, b.seq AS best_seq, b.confidence AS frame_confidence,
  votes * 1.25E0 + ac * 0.75E0 + aq * 0.45E0 + {fmt('k.consensus')} * 0.85E0 + least(b.sharpness / 200E0, 1E0) * 0.3E0 AS score
  FROM stats s JOIN cons k ON k.gid = s.gid JOIN bests b ON b.gid = s.pass_id AND b.c = s.c),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY round(score, 12) DESC, c) AS r,
  count(*) OVER (PARTITION BY pass_id) AS n_clusters, sum(votes) OVER (PARTITION BY pass_id) AS n_candidates FROM scored) q WHERE r = 1),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY has_bbox DESC, CASE WHEN has_bbox THEN quality END DESC,
  CASE WHEN has_bbox THEN sharpness END DESC, frame_rank) AS r, count(*) OVER (PARTITION BY pass_id) AS window_size FROM sel) q WHERE r = 1)"""


VOTE_ORACLE_BODY = f"""
SELECT f.pass_id, coalesce(w.consensus, f.plate_text) AS plate_text, round(coalesce(w.ac, f.confidence), 9) AS plate_confidence,
  coalesce(w.frame_confidence, 0E0) AS frame_confidence, coalesce(w.votes >= 7 AND {valid('w.consensus')}, false) AS plate_text_valid,
  CAST(coalesce(w.votes, 0) AS INTEGER) AS votes, CAST(coalesce(w.n_clusters, 0) AS INTEGER) AS n_clusters,
  CAST(coalesce(w.n_candidates, 0) AS INTEGER) AS n_candidates, f.window_size, coalesce(w.votes >= 7, false) AS min_candidates_met,
  round(coalesce(w.score, 0E0), 9) AS score, coalesce(w.best_seq, f.seq) AS best_seq,
  CASE WHEN w.consensus IS NULL THEN '' WHEN substr(w.consensus, 3, 2) = 'BH' THEN 'BH'
    WHEN substr(w.consensus, 1, 2) IN (SELECT code FROM codes) THEN substr(w.consensus, 1, 2) ELSE '' END AS plate_state_code
FROM fb f LEFT JOIN win w ON w.pass_id = f.pass_id"""


@query("w4_vote_plate", oracle=_oracle(_BEST_SQL, VOTE_ORACLE_BODY))
def _w4(t):
    return voting.vote_plate(selected(t)).withColumns(
        {"plate_confidence": F.round("plate_confidence", 9), "score": F.round("score", 9)})


# Crop attempts: the first six reads of a pass stand for the six framings of one image.
_FRAMES_SQL = ", ".join(f"'{f}'" for f in voting.FRAMINGS)
_TRIES_SQL = f"""
tries AS (SELECT *, [{_FRAMES_SQL}][attempt] AS framing FROM (SELECT pass_id, {NORM_SQL.format('plate_text')} AS n, confidence,
  row_number() OVER (PARTITION BY pass_id ORDER BY seq) AS attempt FROM v_plate_reads) q WHERE attempt <= 6)"""


def attempt_sql(tries):
    """Scored candidates and supported groups of the attempts in ``tries``, as common table expressions."""
    return f"""
{CODES_SQL},{tries},
texts AS (SELECT DISTINCT n FROM tries),{MERGED_SQL},
att AS (SELECT t.pass_id, t.attempt, m.first_gen AS gen, m.text, m.tag, t.framing,
  t.confidence * 0.68E0 + m.score * 0.22E0 + (CASE WHEN {valid('m.text')} THEN 1E0 ELSE 0E0 END) * 0.1E0 - {penalty('m.text')} AS score
  FROM tries t JOIN merged m ON m.n = t.n),
ordered AS (SELECT pass_id AS gid, row_number() OVER (PARTITION BY pass_id ORDER BY score DESC, attempt, gen) AS k, text AS n,
  attempt, gen, tag, framing, score FROM att),""" + LEADERS_SQL + """,
sup AS (SELECT gid, c, count(DISTINCT framing) AS n_framings, max(score) AS best, count(DISTINCT length(n)) AS n_lens,
  least(count(DISTINCT framing) - 1, 4) * 0.03E0 AS bonus FROM assigned GROUP BY gid, c)"""


_ATTEMPT_SQL = attempt_sql(_TRIES_SQL)


_SUPPORT_SQL = """
SELECT s.gid AS pass_id, CAST(s.c AS INTEGER) AS cluster, d.leaders[s.c + 1] AS representative, CAST(n_framings AS INTEGER) AS n_framings,
  round(bonus, 9) AS support_bonus FROM sup s JOIN led d ON d.gid = s.gid"""


@query("a7_framing_support", oracle=_oracle(_ATTEMPT_SQL, _SUPPORT_SQL))
def _a7(t):
    return voting.framing_support(voting.attempt_candidates(t.view("plate_reads"))).select(
        "pass_id", "cluster", "representative", "n_framings", F.round("support_bonus", 9).alias("support_bonus"))


_RANKED_SQL = """,
bestg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY best + bonus DESC, c) AS r FROM sup) q WHERE r = 1),
grp AS (SELECT a.gid, a.k AS ord, a.n FROM assigned a JOIN bestg b ON b.gid = a.gid AND b.c = a.c),""" + CONSENSUS_SQL + """,
texts2 AS (SELECT DISTINCT v AS n FROM voted WHERE size > 1),""" + second_copy(MERGED_SQL, "2") + """,
first AS (SELECT a.gid, arg_min(a.k, a.k) AS wk, arg_min(a.n, a.k) AS wn, any_value(b.n_lens) AS n_lens
  FROM assigned a JOIN bestg b ON b.gid = a.gid AND b.c = a.c GROUP BY a.gid),
swap AS (SELECT f.*, CASE WHEN n_lens > 1 AND size > 1 THEN coalesce(h.text, w.v) END AS cons FROM first f JOIN voted w ON w.gid = f.gid
  LEFT JOIN chosen2 h ON h.n = w.v),
sw AS (SELECT *, coalesce(length(cons) >= length(wn) AND cons <> wn AND length(cons) > 0, false) AS swapped FROM swap),
lines AS (
  SELECT o.gid, 1 AS is_winner, s.swapped, CASE WHEN s.swapped THEN s.cons ELSE o.n END AS cand_text, o.attempt, o.gen, o.tag, o.framing, o.score
  FROM ordered o JOIN sw s ON s.gid = o.gid AND s.wk = o.k
  UNION ALL
  SELECT o.gid, 0, false, o.n, o.attempt, o.gen, o.tag, o.framing, o.score FROM ordered o JOIN sw s ON s.gid = o.gid
  WHERE s.swapped OR o.k <> s.wk)"""


_LINES_SQL = """
SELECT gid AS pass_id, CAST(row_number() OVER (PARTITION BY gid ORDER BY is_winner DESC, score DESC, attempt, gen) AS INTEGER) AS rank,
  swapped, cand_text, CAST(attempt AS INTEGER) AS attempt, tag AS cand_tag, framing, round(score, 9) AS score FROM lines"""


@query("s3_rank_candidates", oracle=_oracle(_ATTEMPT_SQL + _RANKED_SQL, _LINES_SQL))
def _s3(t):
    return _ranked(voting.attempt_candidates(t.view("plate_reads")))


def _ranked(cands):
    ranked = voting.rank_candidates(cands)
    return ranked.select("pass_id", "rank", "swapped", "cand_text", "attempt", "cand_tag", "framing", F.round("score", 9).alias("score"))


# Every third pass has a crop as high as wide, whose two lines are the halves of its first read; some lack the lower one.
_TWO_LINE_TRIES = f"""
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY seq) AS k FROM v_plate_reads) q WHERE k = 1 AND pass_id % 3 = 0),
halves AS (SELECT pass_id, {NORM_SQL.format("coalesce(substr(plate_text, 1, 4), '')")} || {NORM_SQL.format("coalesce(substr(plate_text, 5), '')")} AS n, confidence, quality
  FROM firsts WHERE pass_id % 9 <> 0),
tries AS (SELECT pass_id, n, CASE WHEN n = '' THEN 0E0 ELSE (confidence + quality) / 2 END AS confidence, 1 AS attempt, 'double_line' AS framing FROM halves
  UNION ALL SELECT pass_id, n, confidence, k + two, [{_FRAMES_SQL}][k] FROM (SELECT pass_id, {NORM_SQL.format('plate_text')} AS n, confidence,
    row_number() OVER (PARTITION BY pass_id ORDER BY seq) AS k, CASE WHEN pass_id % 3 = 0 THEN 1 ELSE 0 END AS two FROM v_plate_reads) q WHERE k + two <= 6)"""


def _two_line_candidates(t):
    reads = t.view("plate_reads")
    crops = reads.select("pass_id").distinct().select(
        "pass_id", F.lit(120).alias("w"), F.when(F.col("pass_id") % 3 == 0, F.lit(120)).otherwise(F.lit(30)).alias("h"), F.lit(90.0).alias("sharpness"))
    first = reads.groupBy("pass_id").agg(F.min_by(F.struct("plate_text", "confidence", "quality"), "seq").alias("f"))
    top = first.select("pass_id", F.lit(0).alias("row"), F.substring("f.plate_text", 1, 4).alias("text"), F.col("f.confidence").alias("confidence"))
    low = first.filter("pass_id % 9 <> 0").select("pass_id", F.lit(1).alias("row"), F.expr("substring(f.plate_text, 5)").alias("text"), F.col("f.quality").alias("confidence"))
    return voting.attempt_candidates(reads, shapes=evidence.crop_metrics(crops), rows=top.unionByName(low))


@query("a7_framing_support_two_line", oracle=_oracle(attempt_sql(_TWO_LINE_TRIES), _SUPPORT_SQL))
def _a7_two_line(t):
    return voting.framing_support(_two_line_candidates(t)).select(
        "pass_id", "cluster", "representative", "n_framings", F.round("support_bonus", 9).alias("support_bonus"))


@query("s3_rank_candidates_two_line", oracle=_oracle(attempt_sql(_TWO_LINE_TRIES) + _RANKED_SQL, _LINES_SQL))
def _s3_two_line(t):
    return _ranked(_two_line_candidates(t))


_FIRST_PASS = "fast AS (SELECT seq AS read_id, plate_text AS text, confidence, 'original:raw' AS variant, seq % 6 = 5 AS double_line FROM v_plate_reads)"
_REFINED = "slow AS (SELECT seq AS read_id, CASE WHEN seq % 4 = 0 THEN '' ELSE lower(plate_text) END AS refined_text, 0.99E0 AS refined_confidence FROM v_plate_reads WHERE seq % 3 <> 0)"


@query("p15_refine_reads", oracle=with_views("plate_reads", body=f"""
{CODES_SQL},{_FIRST_PASS},{_REFINED},
pairs AS (SELECT f.*, {NORM_SQL.format("coalesce(s.refined_text, '')")} AS r, s.refined_confidence FROM fast f LEFT JOIN slow s ON s.read_id = f.read_id),
texts AS (SELECT DISTINCT r AS n FROM pairs WHERE double_line),{MERGED_SQL}
SELECT p.read_id, CASE WHEN p.r = '' THEN p.text WHEN p.double_line THEN coalesce(c.text, p.r) ELSE p.r END AS text,
  CASE WHEN p.r = '' THEN p.confidence ELSE p.refined_confidence END AS confidence,
  CASE WHEN p.r = '' THEN p.variant ELSE p.variant || '+sar' END AS variant FROM pairs p LEFT JOIN chosen c ON c.n = p.r"""))
def _p15(t):
    reads = t.view("plate_reads")
    fast = reads.select(F.col("seq").alias("read_id"), F.col("plate_text").alias("text"), "confidence",
                        F.lit("original:raw").alias("variant"), (F.col("seq") % 6 == 5).alias("double_line"))
    slow = reads.filter("seq % 3 <> 0").select(
        F.col("seq").alias("read_id"), F.when(F.col("seq") % 4 == 0, F.lit("")).otherwise(F.lower("plate_text")).alias("refined_text"),
        F.lit(0.99).alias("refined_confidence"))
    return voting.refine_reads(fast, slow)


@query("p14_join_two_line", oracle=with_views("plate_reads", body=f"""
halves AS (SELECT seq AS read_id, 0 AS r, substr(plate_text, 1, 4) AS text, confidence FROM v_plate_reads
  UNION ALL SELECT seq, 1, substr(plate_text, 5), CASE WHEN seq % 3 = 0 THEN 0E0 ELSE quality END FROM v_plate_reads)
SELECT read_id, string_agg(text, '' ORDER BY r) AS text, round(CASE WHEN string_agg(text, '' ORDER BY r) = '' THEN 0E0
  ELSE coalesce(avg(confidence) FILTER (confidence > 0), 0E0) END, 9) AS confidence FROM halves GROUP BY read_id"""))
def _p14(t):
    reads = t.view("plate_reads")
    top = reads.select(F.col("seq").alias("read_id"), F.lit(0).alias("row"), F.substring("plate_text", 1, 4).alias("text"), "confidence")
    low = reads.select(F.col("seq").alias("read_id"), F.lit(1).alias("row"), F.expr("substring(plate_text, 5)").alias("text"),
                       F.when(F.col("seq") % 3 == 0, F.lit(0.0)).otherwise(F.col("quality")).alias("confidence"))
    return voting.join_two_line(top.unionByName(low)).withColumn("confidence", F.round("confidence", 9))


@query("j6_similar_plates", oracle=with_views("plate_reads", "registry", body=f"""
a AS (SELECT {NORM_SQL.format('plate_text')} AS l, count(*) AS n_left FROM v_plate_reads GROUP BY 1 HAVING l <> ''),
b AS (SELECT {NORM_SQL.format('license_plate')} AS r, count(*) AS n_right FROM v_registry GROUP BY 1 HAVING r <> '')
SELECT l AS left_text, r AS right_text, n_left, n_right, CAST(levenshtein(l, r) AS INTEGER) AS distance FROM a, b WHERE {similar('l', 'r')}"""))
def _j6(t):
    return joins.similar_plates(
        t.view("plate_reads").select("plate_text"), t.view("registry").select(F.col("license_plate").alias("plate_text")))
