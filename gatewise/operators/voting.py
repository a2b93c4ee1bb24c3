"""From per-frame plate reads to one voted plate per pass.

A pass enters the vote with its best frames only (at most ``pick``), so the arrays below are bounded
by the selection, not by the data. Everything after the one shuffle by pass is computed inside rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.functions import plates as P
from gatewise.operators import grammar

KEEP_FRAMES, PICK_FRAMES, MIN_CANDIDATES = 40, 10, 7


def best_plate_frames(frames: DataFrame, keep: int = KEEP_FRAMES, pick: int = PICK_FRAMES,
                      score: str = "quality", seq: str = "seq", group: str = "pass_id") -> DataFrame:
    """Best frames per pass with their rank; newest wins ties. Keeping 40 and then picking 10 is one
    rank limit, which Spark also applies before the shuffle, so a huge pass sends only its best."""
    w = W.partitionBy(group).orderBy(F.desc(score), F.desc(seq))
    return frames.withColumn("frame_rank", F.row_number().over(w)).filter(F.col("frame_rank") <= min(keep, pick))


def best_driver_frame(frames: DataFrame, entry_frames: DataFrame, group: str = "pass_id") -> DataFrame:
    """Best driver frame per pass; the frame frozen at entry serves passes without any frame."""
    best = frames.groupBy(group).agg(
        F.max_by("frame_id", F.struct("score", "seq")).alias("best_frame"), F.max("score").alias("best_score"))
    return entry_frames.join(best, group, "left").select(
        group,
        F.coalesce("best_frame", "entry_frame").alias("driver_frame"),
        F.col("best_frame").isNull().alias("is_fallback"),
    )


def _members(reads: DataFrame, order: str, group: str, extra: list[str]) -> DataFrame:
    """One row per group: its usable reads in order (bounded by the frame selection)."""
    item = F.struct(F.col(order).alias("ord"), P.normalize_plate(F.col("plate_text")).alias("n"), *extra)
    usable = F.col("has_bbox") & F.col("plate_text").rlike("[A-Za-z0-9]")
    return reads.filter(usable).groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("members"))


def _within(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``plates.similar`` for rows of code points, by the five diagonals of the distance table that two edits can reach."""
    limit, far, n = np.where(np.maximum(la, lb) <= 7, 1, 2), np.int8(3), len(a)
    ok = np.flatnonzero((la > 0) & (lb > 0) & (np.abs(la - lb) <= 2))
    a, b, la, lb = a[ok], b[ok], la[ok], lb[ok]
    width = a.shape[1]
    wide = np.zeros((len(ok), width + 5), a.dtype)  # b from place 2 on; what lies outside equals nothing that counts
    wide[:, 2 : 2 + b.shape[1]] = b
    # line[d + 2]: distance of the first i characters of a and the first i + d of b.
    line = [np.full(len(ok), 3, np.int8)] * 2 + [np.full(len(ok), d, np.int8) for d in range(3)]
    found = np.full(len(ok), 3, np.int8)
    for i in range(width + 1):
        if i:
            fresh: list[np.ndarray] = []
            for d in range(-2, 3):
                if i + d < 0:
                    fresh.append(np.full(len(ok), 3, np.int8))
                    continue
                best = line[d + 2] + (a[:, i - 1] != wide[:, i + d + 1]) if i + d else np.full(len(ok), 3, np.int8)
                if d < 2:
                    best = np.minimum(best, line[d + 3] + np.int8(1))
                if d > -2:
                    best = np.minimum(best, fresh[-1] + np.int8(1))
                fresh.append(np.minimum(best, far).astype(np.int8))
            line = fresh
        here = la == i
        if here.any():
            found[here] = np.stack([x[here] for x in line])[(lb - la)[here] + 2, np.arange(int(here.sum()))]
    out = np.zeros(n, bool)
    out[ok] = found <= limit[ok]
    return out


#: Members that are held against leaders together, at most (more, if one group has more).
TOGETHER = 1 << 16


def find_leaders(groups: list[list[str | None]]) -> tuple[list[list[str | None]], list[list[int]]]:
    """Of each group its leaders, and of each member the index of the first leader it resembles, -1 for an empty one.

    Round by round, the first member of each group without a leader becomes one and takes what resembles it.
    """
    leaders, places = [], []
    at = 0
    while at < len(groups):
        end, n = at, 0
        while end < len(groups) and (end == at or n + len(groups[end]) <= TOGETHER):
            n, end = n + len(groups[end]), end + 1
        led, found = _lead(groups[at:end])
        leaders += led
        places += found
        at = end
    return leaders, places


def _lead(groups: list[list[str | None]]) -> tuple[list[list[str | None]], list[list[int]]]:
    texts = [t for g in groups for t in g]
    known = {t: k for k, t in enumerate(dict.fromkeys(t or "" for t in texts))}
    number = np.fromiter((known[t or ""] for t in texts), np.int64, len(texts))
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    codes = _codes(list(known), int(sizes.max(initial=0)))
    lengths = np.fromiter(map(len, groups), np.int64, len(groups))
    starts = np.cumsum(lengths) - lengths
    group = np.repeat(np.arange(len(groups)), lengths)
    leaders: list[list[str | None]] = [[] for _ in groups]
    place, left = np.full(len(texts), -1, np.int64), np.arange(len(texts))
    while len(left):
        heads = left[np.unique(group[left], return_index=True)[1]]
        head = np.zeros(len(groups), np.int64)
        head[group[heads]] = heads
        mine = head[group[left]]
        pair, back = np.unique(number[mine] * len(known) + number[left], return_inverse=True)
        x, y = pair // len(known), pair % len(known)
        alike = _within(codes[x], codes[y], sizes[x], sizes[y])[back]
        for k in heads.tolist():
            leaders[group[k]].append(texts[k])
        turn = np.fromiter((len(leaders[g]) - 1 for g in group[left].tolist()), np.int64, len(left))
        place[left[alike]] = turn[alike]
        left = left[~alike & (left != mine)]
    return leaders, [place[s : s + n].tolist() for s, n in zip(starts.tolist(), lengths.tolist())]


def _led(texts: pa.Array) -> pa.Array:
    rows = texts.to_pylist()
    leaders, places = find_leaders([r or [] for r in rows])
    gone = np.array([r is None for r in rows], bool)
    kinds = (pa.list_(pa.string()), pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip((leaders, places), kinds)], ["leaders", "c"], mask=pa.array(gone))


def with_leaders(df: DataFrame, members: str = "members", text: str = "n") -> DataFrame:
    """Adds ``leaders``: texts that start a cluster when members are taken in order, and to every
    member its cluster index ``c``, the first leader it resembles. Groups of a batch are worked out together."""
    led = F.arrow_udf(_led, "leaders array<string>, c array<int>").asNondeterministic()(F.transform(members, lambda m: m[text]))
    return df.withColumn("_led", led).withColumns({
        "leaders": F.col("_led.leaders"), members: F.zip_with(members, "_led.c", lambda m, c: m.withField("c", c))}).drop("_led")


def cluster_reads(reads: DataFrame, order: str = "frame_rank", group: str = "pass_id") -> DataFrame:
    """Cluster index and representative of every usable read of the selected frames."""
    rows = with_leaders(_members(reads, order, group, ["seq"])).select(group, "leaders", F.explode("members").alias("m"))
    return rows.select(
        group, F.col("m.seq").alias("seq"), F.col("m.n").alias("norm_text"), F.col("m.c").alias("cluster"),
        F.element_at("leaders", F.col("m.c") + 1).alias("representative"))


def read_clusters(reads: DataFrame, order: str = "frame_rank", group: str = "pass_id") -> DataFrame:
    """One row per cluster with its members in order. Stays partitioned by the group key."""
    extra = ["seq", "confidence", "quality", "sharpness"]
    led = with_leaders(_members(reads, order, group, extra))
    rows = led.select(group, F.size("leaders").alias("n_clusters"), F.size("members").alias("n_candidates"),
                      F.posexplode("leaders").alias("cluster", "representative"), "members")
    return rows.withColumn("members", F.filter("members", lambda m: m["c"] == F.col("cluster")))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """Votes, mean confidence and mean quality of each cluster."""
    mean = lambda f: F.aggregate("members", F.lit(0.0), lambda a, m: a + m[f]) / F.size("members")
    return clusters.withColumns(
        {"votes": F.size("members"), "avg_confidence": mean("confidence"), "avg_quality": mean("quality")})


def _most_common(items: str) -> str:
    """SQL for the most common element of an array, the one seen first on ties, as (n, first, v); null
    when empty. Counts each distinct element once."""
    return (
        f"array_max(transform(array_distinct({items}), v -> named_struct("
        f"'n', size(filter({items}, x -> x = v)), 'first', -array_position({items}, v), 'v', v)))"
    )


def modal_length(members: str = "members") -> Column:
    """Most common text length; the length seen first wins ties."""
    return F.expr(_most_common(f"transform({members}, m -> length(m.n))") + ".v")


def with_modal_length(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("modal_length", modal_length())


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def align(reference: str, other: str) -> str:
    """SQL that lays ``other`` over the positions of ``reference`` by edit distance, with a space where
    nothing aligns.

    ``d`` holds, for each number of reference characters, the distances to every prefix of the other.
    The way back keeps (i, j) prefixes still to lay; of equally short ways it takes the one that lays a
    character, then the one that leaves the position blank, then the one that drops a character.
    """
    differs = lambda i, j: f"if(substring(r, {i}, 1) = substring(o, {j}, 1), 0, 1)"
    row = (f"aggregate(sequence(1, length(o)), array(i), (line, j) -> array_append(line, least("
           f"element_at(d, i)[j - 1] + {differs('i', 'j')}, element_at(d, i)[j] + 1, line[j - 1] + 1)))")
    table = f"aggregate(sequence(1, length(r)), array(sequence(0, length(o))), (d, i) -> array_append(d, {row}))"
    here = "d[s.i][s.j]"
    back = (
        "aggregate(sequence(1, length(r) + length(o)), named_struct('i', length(r), 'j', length(o), 't', ''), (s, step) -> CASE "
        "WHEN s.i = 0 OR s.j = 0 THEN s "
        f"WHEN {here} = d[s.i - 1][s.j - 1] + {differs('s.i', 's.j')} THEN named_struct('i', s.i - 1, 'j', s.j - 1, 't', concat(substring(o, s.j, 1), s.t)) "
        f"WHEN {here} = d[s.i - 1][s.j] + 1 THEN named_struct('i', s.i - 1, 'j', s.j, 't', concat(' ', s.t)) "
        "ELSE named_struct('i', s.i, 'j', s.j - 1, 't', s.t) END, s -> lpad(s.t, length(r), ' '))")
    laid = f"if(length(r) = 0 OR length(o) = 0, repeat(' ', length(r)), {_let('d', table, back)})"
    return _let("r", reference, _let("o", other, laid))


#: Cells of the distance tables that are worked out together.
CELLS = 1 << 20


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of the texts, one row each, filled up with zeros."""
    out = np.zeros((len(texts), width), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def lay_over(pairs: list[tuple[str, str]]) -> list[str]:
    """What ``align`` gives for pairs (reference, other), all pairs of about one size at a time."""
    found: list[str] = [""] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        width, high, end = 0, 0, at
        while end < len(order):
            r, o = pairs[order[end]]
            if end > at and (end - at + 1) * (max(high, len(r)) + 1) * (max(width, len(o)) + 1) > CELLS:
                break
            high, width, end = max(high, len(r)), max(width, len(o)), end + 1
        block = order[at:end]
        for k, text in zip(block, _lay_block([pairs[k][0] for k in block], [pairs[k][1] for k in block], high, width)):
            found[k] = text
        at = end
    return found


def _lay_block(references: list[str], others: list[str], high: int, width: int) -> list[str]:
    n, r, o = np.arange(len(references)), _codes(references, high), _codes(others, width)
    i, j = (np.fromiter(map(len, x), np.int64, len(x)) for x in (references, others))
    out = np.where(np.arange(high) < i[:, None], np.uint32(ord(" ")), np.uint32(0))
    sizes, steps = i.copy(), np.arange(width + 1, dtype=np.int32)
    d = np.empty((high + 1, len(n), width + 1), np.int32)
    d[0] = steps
    for k in range(1, high + 1):
        d[k, :, 0] = k
        d[k, :, 1:] = np.minimum(d[k - 1, :, :-1] + (r[:, k - 1, None] != o), d[k - 1, :, 1:] + 1)
        d[k] = np.minimum.accumulate(d[k] - steps, axis=1) + steps
    while True:
        live = np.flatnonzero((i > 0) & (j > 0))
        if not len(live):
            return [row[:size].tobytes().decode("utf-32-le", "surrogatepass") for row, size in zip(out, sizes.tolist())]
        a, b = i[live], j[live]
        here, char = d[a, live, b], o[live, b - 1]
        lays = here == d[a - 1, live, b - 1] + (r[live, a - 1] != char)
        blank = ~lays & (here == d[a - 1, live, b] + 1)
        out[live[lays], a[lays] - 1] = char[lays]
        i[live] -= lays | blank
        j[live] -= ~blank


def _aligned(reference: pa.Array, texts: pa.Array) -> pa.Array:
    rows = list(zip(reference.to_pylist(), texts.to_pylist()))
    uneven = {(r, t): "" for r, ts in rows if r is not None and ts is not None for t in ts if t is not None and len(t) != len(r)}
    uneven = dict(zip(uneven, lay_over(list(uneven))))
    return pa.array([None if r is None or ts is None else [uneven.get((r, t), t) for t in ts] for r, ts in rows], pa.list_(pa.string()))


def aligned_texts(reference: Column, texts: Column) -> Column:
    """``texts`` laid over ``reference`` (see ``align``); those of its length stay as they are. Each distinct pair of a batch
    is aligned once. Called nondeterministic only to keep the optimizer from moving it into a lambda above, where it cannot run."""
    return F.arrow_udf(_aligned, "array<string>").asNondeterministic()(reference, texts)


def align_reads(pairs: DataFrame) -> DataFrame:
    """Adds ``aligned`` to pairs (reference, other). Equal lengths stay as they are; the others are
    aligned once per distinct pair."""
    same = F.length("reference") == F.length("other")
    uneven = pairs.filter(~same).select("reference", "other").distinct()
    aligned = uneven.withColumn("aligned", aligned_texts(F.col("reference"), F.array("other"))[0])
    scatter = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*pairs.columns), F.lit(4096)).cast("string"))
    keyed = pairs.withColumn("_o", F.when(same, scatter).otherwise(F.col("other")))
    found = keyed.join(aligned.withColumnRenamed("other", "_o"), ["reference", "_o"], "left")
    return found.withColumn("aligned", F.coalesce("aligned", "other")).select(*pairs.columns, "aligned")


def _with_aligned(clusters: DataFrame) -> DataFrame:
    """Adds ``reference`` (first member of modal length) and ``aligned`` (all members laid over it).

    A text of modal length votes as it is, others as aligned.
    """
    staged = with_modal_length(clusters).withColumn(
        "reference", F.expr("filter(members, m -> length(m.n) = modal_length)[0].n"))
    return staged.withColumn("aligned", aligned_texts(F.col("reference"), F.transform("members", lambda m: m["n"])))


def char_votes(clusters: DataFrame) -> DataFrame:
    """Majority character per position of each cluster's reference; the first cast vote wins ties and a
    position without votes keeps the reference character."""
    rows = _with_position_votes(_with_aligned(clusters), "_votes").withColumn("_v", F.explode("_votes"))
    keys = [c for c in clusters.columns if c not in ("members",)]
    return rows.select(*keys, F.col("_v.pos").alias("pos"), F.col("_v.ch").alias("char"), F.col("_v.n").alias("n_votes"))


def _with_position_votes(aligned: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: (pos, ch, n) per reference position. The staged array of cast characters keeps
    each vote list evaluated once."""
    cast = ("transform(sequence(1, modal_length), p -> filter(transform(aligned, t -> substring(t, p, 1)), ch -> ch <> ' '))")
    top = f"transform(_cast, c -> {_most_common('c')})"
    return (
        aligned.withColumn("_cast", F.expr(cast))
        .withColumn("_top", F.expr(top))
        .withColumn(out, F.expr(
            "transform(_top, (b, i) -> named_struct('pos', i + 1, 'ch', coalesce(b.v, substring(reference, i + 1, 1)), "
            "'n', coalesce(b.n, 0)))"))
        .drop("_cast", "_top")
    )


def with_consensus(clusters: DataFrame, keys: list[str], out: str = "consensus") -> DataFrame:
    """Consensus text of each cluster: a single read stands as it is, several vote per character and
    the result goes through plate correction."""
    voted = _with_position_votes(_with_aligned(clusters), "_votes").withColumn(
        "_voted", F.expr("array_join(transform(_votes, v -> v.ch), '')"))
    # Only texts of more than one read are corrected; the rest pass an empty text.
    voted = voted.withColumn("_fix", F.when(F.size("members") > 1, F.col("_voted")).otherwise(F.lit("")))
    chosen = grammar.with_choice_in_place(voted, "_fix", keys, "_chosen")
    return chosen.withColumn(
        out, F.when(F.size("members") > 1, F.col("_chosen")).otherwise(F.col("reference"))
    ).drop("_votes", "_voted", "_fix", "_chosen", "aligned", "reference", "modal_length")


def vote_plate(reads: DataFrame, min_candidates: int = MIN_CANDIDATES, order: str = "frame_rank",
               group: str = "pass_id") -> DataFrame:
    """One voted plate per pass from its selected frames.

    Clusters are scored by votes, confidence, quality, format of the consensus and sharpness of the
    best read; a pass without any usable text falls back to its best detected crop.
    """
    scored = with_consensus(cluster_stats(read_clusters(reads, order, group)), [group, "cluster"])
    sharp = lambda c: F.least(c / F.lit(200.0), F.lit(1.0))
    best = F.expr(
        "array_max(transform(members, (m, i) -> named_struct('conf', m.confidence, 'q', m.quality, "
        "'sh', least(m.sharpness / 200E0, 1E0), 'fmt', "
        f"CASE WHEN m.n RLIKE '{P.KNOWN_FORMAT}' THEN 0.98E0 WHEN m.n RLIKE '{'^' + P._ANY_FORMAT + '$'}' THEN 0.9E0 "
        f"WHEN m.n RLIKE '{P.MIXED_TEXT}' THEN 0.45E0 ELSE 0E0 END, 'first', -i, 'sharpness', m.sharpness, 'seq', m.seq)))"
    )
    scored = scored.withColumn("_best", best).withColumn(
        "score",
        F.col("votes") * F.lit(1.25) + F.col("avg_confidence") * F.lit(0.75) + F.col("avg_quality") * F.lit(0.45)
        + P.format_score(F.col("consensus")) * F.lit(0.85) + sharp(F.col("_best.sharpness")) * F.lit(0.30),
    )
    pick = F.struct("consensus", "avg_confidence", "votes", "score", "n_candidates", "n_clusters",
                    F.col("_best.conf").alias("frame_confidence"), F.col("_best.seq").alias("best_seq"))
    winners = scored.groupBy(group).agg(F.max_by(pick, F.struct("score", -F.col("cluster"))).alias("w"))
    # Fallback crop: best detected read by quality, detection confidence and sharpness, else the first.
    detected = [F.when(F.col("has_bbox"), F.col(c)) for c in ("quality", "det_conf", "sharpness") if c in reads.columns]
    crop = F.struct(F.col("has_bbox").cast("int"), *detected, -F.col(order))
    passes = reads.groupBy(group).agg(
        F.count("*").alias("window_size"), F.max_by("seq", crop).alias("fallback_seq"),
        F.max_by(F.coalesce("plate_text", F.lit("")), crop).alias("fallback_text"),
        F.max_by("confidence", crop).alias("fallback_conf"))
    text = F.coalesce("w.consensus", "fallback_text")
    met = F.coalesce(F.col("w.votes") >= min_candidates, F.lit(False))
    out = passes.join(winners, group, "left").select(
        group,
        text.alias("plate_text"),
        F.coalesce("w.avg_confidence", "fallback_conf").alias("plate_confidence"),
        F.coalesce("w.frame_confidence", F.lit(0.0)).alias("frame_confidence"),
        (met & P.is_valid_format(F.col("w.consensus"))).alias("plate_text_valid"),
        F.coalesce("w.votes", F.lit(0)).alias("votes"),
        F.coalesce("w.n_clusters", F.lit(0)).alias("n_clusters"),
        F.coalesce("w.n_candidates", F.lit(0)).alias("n_candidates"),
        "window_size",
        met.alias("min_candidates_met"),
        F.coalesce("w.score", F.lit(0.0)).alias("score"),
        F.coalesce("w.best_seq", "fallback_seq").alias("best_seq"),
        F.when(F.col("w").isNotNull(), P.state_code(F.col("w.consensus"))).otherwise(F.lit("")).alias("plate_state_code"),
    )
    return out.withColumn("plate_text_valid", F.coalesce("plate_text_valid", F.lit(False)))


# Crop framings in the order they are tried; at most six attempts per image.
FRAMINGS = ("original", "trim10", "trim18", "trim25", "center60", "center50")
MAX_ATTEMPTS = 6


TWO_LINE = "double_line"


def attempts(reads: DataFrame, group: str = "pass_id", seq: str = "seq", shapes: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The first six attempts of each image: group, attempt, framing, plate_text, confidence.

    ``reads`` are the reads of the framings in their order. ``shapes`` (group, double_line, as ``crop_metrics`` tells it)
    says which images have the shape of a two-line plate: such an image is first read as two lines, which counts as its
    first attempt, so that one framing less is tried. ``rows`` (group, row, text, confidence) are the lines of
    those images; without both of them the attempt is spent and gives nothing. An image without a shape, or with an
    unknown one, is read by framings alone.
    """
    tags = lambda names: F.array(*(F.lit(f) for f in names))
    order = F.row_number().over(W.partitionBy(group).orderBy(seq))
    tries = reads.withColumn("attempt", order).filter(F.col("attempt") <= MAX_ATTEMPTS)  # ranks are cut ahead of the shuffle
    if shapes is None:
        framing = F.element_at(tags(FRAMINGS), F.col("attempt"))
        return tries.select(group, "attempt", framing.alias("framing"), "plate_text", "confidence")
    two = shapes.filter("double_line").select(group, F.lit(1).alias("_two")).distinct()
    framed = tries.join(two, group, "left").withColumn("attempt", F.col("attempt") + F.coalesce("_two", F.lit(0))).filter(F.col("attempt") <= MAX_ATTEMPTS)
    framing = F.element_at(tags((*FRAMINGS, *FRAMINGS)), F.when(F.col("_two").isNull(), F.col("attempt")).otherwise(F.col("attempt") - 1))
    out = framed.select(group, "attempt", framing.alias("framing"), "plate_text", "confidence")
    if rows is None:
        return out
    both = rows.filter(F.col("row").isin(0, 1)).groupBy(group).agg(F.count_distinct("row").alias("_n")).filter("_n = 2")
    lines = rows.filter(F.col("row").isin(0, 1)).join(two, group, "left_semi").join(both, group, "left_semi")
    read = join_two_line(lines, group)
    return out.unionByName(read.select(group, F.lit(1).alias("attempt"), F.lit(TWO_LINE).alias("framing"), F.col("text").alias("plate_text"), "confidence"))


def attempt_candidates(reads: DataFrame, group: str = "pass_id", seq: str = "seq", shapes: DataFrame | None = None,
                       rows: DataFrame | None = None) -> DataFrame:
    """Scored candidates of the first six attempts of each image, with the framing of each attempt (see ``attempts``).
    In front of ``refine_reads``, a winner is a double-line one if its framing is ``TWO_LINE``."""
    return grammar.score_candidates(attempts(reads, group, seq, shapes, rows))


def _candidate_groups(cands: DataFrame, group: str) -> DataFrame:
    """Candidates of an image in rank order with their similarity group (bounded by the attempt cap)."""
    item = F.struct(
        (-F.col("rank_score")).alias("neg"), "attempt", "gen", F.col("cand_text").alias("n"),
        "cand_tag", "framing", F.col("rank_score").alias("score"))
    return with_leaders(cands.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("members")))


def framing_support(cands: DataFrame, group: str = "pass_id") -> DataFrame:
    """Distinct crop framings behind each group of similar texts, and the bonus they earn."""
    rows = _candidate_groups(cands, group).select(
        group, F.posexplode("leaders").alias("cluster", "representative"), "members")
    mine = F.filter("members", lambda m: m["c"] == F.col("cluster"))
    n = F.size(F.array_distinct(F.transform(mine, lambda m: m["framing"])))
    return rows.withColumn("members", mine).withColumn("n_framings", n).withColumn(
        "support_bonus", F.least(n - 1, F.lit(4)) * F.lit(0.03))


def rank_candidates(cands: DataFrame, group: str = "pass_id") -> DataFrame:
    """Candidates by score with the winner of the best supported group first. Where the winning group
    mixes lengths, its consensus replaces the winner's text if it is no shorter.

    One shuffle by image; groups, winner and final order are all worked out inside the image's row.
    """
    bonus = "least(size(array_distinct(transform(filter(members, m -> m.c = k), m -> m.framing))) - 1, 4) * 0.03E0"
    ranked = (
        "-array_max(transform(sequence(0, size(leaders) - 1), k -> named_struct("
        f"'r', filter(members, m -> m.c = k)[0].score + {bonus}, 'first', -k))).first")
    # The best group is found once: a column of its own would be inlined into the lambda and found for every member.
    mine = F.expr(_let("best", ranked, "filter(members, m -> m.c = best)"))
    best = _candidate_groups(cands, group).select(group, F.col("members").alias("everyone"), mine.alias("members"))
    mixed = F.expr("size(array_distinct(transform(members, m -> length(m.n)))) > 1")
    decided = with_consensus(best, [group]).withColumn("_w", F.col("members")[0]).withColumn(
        "_text", F.when(mixed, F.col("consensus")))
    swapped = F.coalesce(
        (F.length("_text") > 0) & (F.length("_text") >= F.length("_w.n")) & (F.col("_text") != F.col("_w.n")), F.lit(False))
    decided = decided.withColumn("_swapped", swapped)
    line = ("named_struct('swapped', {swapped}, 'cand_text', {text}, 'attempt', {m}.attempt, 'gen', {m}.gen, "
            "'cand_tag', {m}.cand_tag, 'framing', {m}.framing, 'score', {m}.score)")
    head = line.format(swapped="_swapped", text="if(_swapped, _text, _w.n)", m="_w")
    rest = line.format(swapped="false", text="m.n", m="m")
    lines = F.expr(
        f"concat(array({head}), transform(filter(everyone, m -> _swapped OR m.attempt <> _w.attempt OR m.gen <> _w.gen), m -> {rest}))")
    rows = decided.select(group, F.posexplode(lines).alias("_pos", "_l"))
    return rows.select(group, (F.col("_pos") + 1).alias("rank"), "_l.*")


def refine_reads(best: DataFrame, refined: DataFrame, key: str = "read_id") -> DataFrame:
    """Take the slow reader's text where it is not empty, else keep the fast one. Only double-line
    refinements go through plate correction."""
    norm = P.normalize_plate(F.col("refined_text"))
    joined = best.join(refined.select(key, "refined_text", "refined_confidence"), key, "left").withColumn("_r", norm)
    joined = joined.withColumn("_fix", F.when(F.col("double_line"), F.col("_r")).otherwise(F.lit("")))
    fixed = grammar.with_choice(joined, "_fix", "_chosen", "_tag", "_score")
    text = F.when(F.col("double_line"), F.col("_chosen")).otherwise(F.col("_r"))
    taken = F.col("_r") != ""
    return fixed.select(
        key,
        F.when(taken, text).otherwise(F.col("text")).alias("text"),
        F.when(taken, F.col("refined_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(taken, F.concat("variant", F.lit("+sar"))).otherwise(F.col("variant")).alias("variant"),
    )


def join_two_line(rows: DataFrame, key: str = "read_id") -> DataFrame:
    """Top and bottom texts joined; confidence is the mean of the positive ones (0 without any text)."""
    n = P.normalize_plate(F.col("text"))
    # Two rows per read, so the ordered array is bounded by the layout.
    joined = rows.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", n.alias("n")))), lambda r: r["n"]), "").alias("text"),
        F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("c"))
    return joined.select(key, "text", F.when(F.col("text") == "", F.lit(0.0)).otherwise(F.coalesce("c", F.lit(0.0))).alias("confidence"))


def consensus_text(texts: str, order: str) -> Column:
    """Aggregate of one selected group of reads (at most the frame selection): its majority text, votes
    cast in ``order``, without correction."""
    pick = f"struct({order} AS o, coalesce(upper(regexp_replace({texts}, '[^A-Za-z0-9]', '')), '') AS n)"
    seen = f"filter(transform(array_sort(collect_list({pick})), x -> x.n), n -> n <> '')"
    size = _most_common("transform(seen, n -> length(n))") + ".v"
    laid = f"transform(seen, n -> if(length(n) = modal, n, {align('lead', 'n')}))"
    cast = "filter(transform(laid, n -> substring(n, p, 1)), c -> c <> ' ')"
    text = f"array_join(transform(sequence(1, modal), p -> {_let('votes', cast, 'coalesce(' + _most_common('votes') + '.v, substring(lead, p, 1))')}), '')"
    voted = _let("modal", size, _let("lead", "filter(seen, n -> length(n) = modal)[0]", _let("laid", laid, text)))
    return F.expr(_let("seen", seen, f"if(size(seen) = 0, '', {voted})"))
