"""Jaccard join of documents' word n-gram sets over a prefix tree.

All sets follow one global order of n-grams: rare ones by hash, then those that many sets have, by how many.
Two sets that are similar enough share several n-grams among their first ones in that order, so those meet by
n-gram, and pairs that meet once by chance fall away. Each set then walks a tree of the candidate sets it met: shared beginnings are counted once, and a
subtree is left as soon as what remains of both sides cannot reach the overlap that its sizes ask for.

Sets that many documents have exactly are one class. Where an n-gram is common in spite of the order, as in a
crowd of near copies, its sets are first held against a few of their own; only sets that this leaves apart
are held against all the others there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.llm.common import Words, bloom_has, bloom_words, connected_components, fresh, list_array, mix, query, slices, split_rows, table
from gatewise.session import cut_lineage

#: Of the first n-grams of two similar sets this many agree, or all that they need to share if that is less.
SHARED = 4
#: Sets that meet at one n-gram up to which all pairs are held against each other.
CROWD = 16
#: n-grams moved to the end of the order, at most; more would only save work.
COMMON = 1 << 18
SET_FILTER = 19
TREE_SETS = 2048
CROWD_BLOCK = 4096

_U = np.uint64


def set_slices(words: Words, column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ascending distinct n-gram hashes of each text); a text of fewer than k words is one n-gram."""
    for lo, data, offsets in slices(column):
        hashes, first = words.hashes(data, offsets)
        grams, out = words.shingles(hashes, k), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                out.append(words.shingles(hashes[a:b], b - a))
            else:
                out.append(np.zeros(0, _U))
        yield lo, out


def class_of(grams: np.ndarray) -> int:
    """A hash of a set as a whole, signed."""
    return int(mix(np.array([mix(grams).sum(dtype=_U) ^ _U(len(grams))], _U)).view(np.int64)[0])


def needed(n: int, num: int, den: int) -> int:
    """Overlap that a set of n n-grams needs at least with any set similar to it."""
    return -(-num * n // den)


def head(n: int, num: int, den: int) -> int:
    """Number of first n-grams among which a similar set has SHARED in common."""
    return min(n, n - needed(n, num, den) + SHARED)


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """One bit for each bucket of hashes, telling whether an odd number of n-grams falls there, in 64-bit words; about
    as many bits as n-grams. Bits in which two sets differ are no more than the n-grams in which they differ."""
    m = 64
    while m < len(grams):
        m *= 2
    odd = np.bincount((mix(grams) & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(_U)


def fold_bits(bits: np.ndarray, words: int) -> np.ndarray:
    """The same for fewer buckets: rows of bits cut into pieces of so many words, which are added."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


#: SQL of the same for columns ``a`` and ``b`` of a pair, sets of ``n`` and ``o_n`` n-grams.
_FOLDED = "transform(sequence(0, {w} - 1), i -> aggregate(sequence(0, size({c}) div {w} - 1), 0L, (x, t) -> x ^ {c}[i + t * {w}]))"
_DIFFER = "aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (t, c) -> t + c)".format(
    a=_FOLDED.format(c="a", w="least(size(a), size(b))"), b=_FOLDED.format(c="b", w="least(size(a), size(b))"))


def can_be_similar(num: int, den: int) -> Column:
    """Whether the sets of a pair (a, n, b, o_n) differ in few enough bits; never false for a similar pair."""
    return F.expr(f"({num} + {den}) * {_DIFFER} <= ({den} - {num}) * (n + o_n)")


class PrefixTree:
    """Ordered sets as a tree whose edges hold runs of n-grams.

    ``nodes``: (run, length so far, smallest and largest set below, sets ending here, children)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())  # shared beginnings are neighbours
        self.nodes: list[tuple] = []
        self.roots: list[int] = []
        todo = [(0, len(order), 0, self.roots)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            a, b = sets[order[lo]], sets[order[hi - 1]]
            most = min(len(a), len(b))
            apart = np.flatnonzero(a[depth:most] != b[depth:most])
            # At the top sets need not share anything: an empty run, and a child for each first n-gram.
            end = depth + int(apart[0]) if len(apart) else most
            sizes = [len(sets[i]) for i in order[lo:hi]]
            children: list[int] = []
            here = lo
            while here < hi and len(sets[order[here]]) == end:
                here += 1
            parent.append(len(self.nodes))
            self.nodes.append((a[depth:end], end, min(sizes), max(sizes), order[lo:here], children))
            while here < hi:
                stop, gram = here + 1, sets[order[here]][end]
                while stop < hi and sets[order[stop]][end] == gram:
                    stop += 1
                todo.append((here, stop, end, children))
                here = stop

    def similar(self, query: np.ndarray, num: int, den: int) -> list[int]:
        """Positions of the sets with den * |overlap| >= num * |union|."""
        found, n = [], len(query)
        todo = [(i, 0) for i in self.roots]
        while todo:
            at, overlap = todo.pop()
            run, length, least, most, ending, children = self.nodes[at]
            rest = n
            if len(run):
                places = np.searchsorted(query, run)
                overlap += int((query[np.minimum(places, n - 1)] == run).sum())
                rest = n - int(np.searchsorted(query, run[-1], "right"))
            elif length:
                continue
            if (num + den) * (overlap + min(rest, most - length)) < num * (n + least):
                continue  # nothing below can overlap enough
            found += [i for i in ending if (num + den) * overlap >= num * (n + length)]
            todo += [(c, overlap) for c in children]
        return found


def _sets_table(docs: DataFrame, k: int, num: int, den: int, text: str, id: str) -> DataFrame:
    """(id, h, cid, n, prefix, bits) of every document: text hash, class, size of the set, its first n-grams by hash, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        for batch in batches:
            for lo, sets in set_slices(words, batch.column(2), k):
                heads = [s[: head(len(s), num, den)] for s in sets]
                bits = [parity_bits(s) for s in sets]
                values = np.concatenate(heads).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo : lo + len(sets)], batch.column(1)[lo : lo + len(sets)], pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), list_array(values, [len(x) for x in heads]),
                     list_array(np.concatenate(bits).view(np.int64), [len(x) for x in bits])], ["id", "h", "cid", "n", "prefix", "bits"])

    kind = docs.schema[id].dataType.simpleString()
    return _read(docs, text, id).mapInArrow(run, f"id {kind}, h long, cid long, n long, prefix array<long>, bits array<long>")


def _read(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(docs[id].alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"), docs[text].alias("text"))


def _reordered(docs: DataFrame, common: pa.Table, k: int, num: int, den: int, text: str, id: str) -> DataFrame:
    """(cid, prefix) of the sets whose first n-grams change when the common ones come last."""
    grams, times = common.column(0).to_numpy().view(_U), common.column(1).to_numpy()
    order = np.argsort(grams)
    shared = docs.sparkSession.sparkContext.broadcast((grams[order], times[order]))  # COMMON numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        hot, rank = shared.value
        for batch in batches:
            cids, heads = [], []
            for _, sets in set_slices(words, batch.column(2), k):
                for s in sets:
                    size = head(len(s), num, den)
                    place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    weight = np.where(hot[place] == s, rank[place], 0)
                    if weight[:size].any():
                        cids.append(class_of(s))
                        heads.append(s[np.lexsort((s, weight))[:size]])
            if cids:
                yield pa.RecordBatch.from_arrays([pa.array(cids), list_array(np.concatenate(heads).view(np.int64), [len(x) for x in heads])], ["cid", "prefix"])

    return _read(docs, text, id).mapInArrow(run, "cid long, prefix array<long>")


def _meet(num: int, den: int, crowd: int):
    """Rows (gram, n, cid) in order of gram and n, to candidate pairs (k, o, n: the smaller set's size, times: n-grams met
    at) and, of crowds, members (k, gram, n)."""

    def pairs(gram: np.ndarray, n: np.ndarray, cid: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(first, len(gram)))
        left, right, least, member, stands = [], [], [], [], []
        for s in np.unique(size[(size > 1) & (size <= crowd)]).tolist():
            at = first[size == s][:, None] + np.arange(s)
            i, j = np.triu_indices(s, 1)
            i, j = at[:, i].ravel(), at[:, j].ravel()
            near = n[i] * den >= num * n[j]
            left.append(np.minimum(cid[i[near]], cid[j[near]]))
            right.append(np.maximum(cid[i[near]], cid[j[near]]))
            least.append(n[i[near]])
        for lo, s in zip(first[size > crowd].tolist(), size[size > crowd].tolist()):
            hi = lo + s
            member.append(np.arange(lo, hi))
            previous = None
            while lo < hi:  # by bands of sizes that can be similar, one set of each stands for it
                end = lo + int(np.searchsorted(n[lo:hi], n[lo] * den // num, "right"))
                middle = (lo + end) // 2
                for stand in {middle, previous} - {None}:
                    others = np.arange(lo, end)
                    others = others[(others != stand) & (np.minimum(n[others], n[stand]) * den >= num * np.maximum(n[others], n[stand]))]
                    stands.append(np.stack([cid[others], np.full(len(others), cid[stand])], 1))
                lo, previous = end, middle
        names = ["k", "o", "gram", "n", "times"]
        if left:
            both, at, times = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), pa.array(np.concatenate(least)[at]), pa.array(times)], names)
        if stands:  # held against each other however often they meet
            both = np.unique(np.concatenate(stands), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), pa.array(np.zeros(len(both), np.int64)), pa.array(np.full(len(both), SHARED))], names)
        if member:
            at, none = np.concatenate(member), pa.nulls(sum(map(len, member)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), none, pa.array(gram[at]), pa.array(n[at]), none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(batch.column(i).to_numpy() for i in range(3))
            if not len(batch):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last n-gram may go on in the next batch
            if last == 0 and kept and kept[-1][0][-1] == now[0][0]:
                kept.append(now)
                continue
            done = [*kept, tuple(x[:last] for x in now)]
            yield from pairs(*(np.concatenate(x) for x in zip(*done)))
            kept = [tuple(x[last:] for x in now)]
        if kept:
            yield from pairs(*(np.concatenate(x) for x in zip(*kept)))

    return run


def _apart(num: int, den: int):
    """Pairs (k, o) of different parts in one crowd, or two blocks of it, whose bits allow them to be similar.

    A pair that meets in several crowds is told in the first of them alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, gram = pdf["lo"].iloc[0], pdf["hi"].iloc[0], int(pdf["gram"].iloc[0])
        earlier = {c: frozenset(g[g < gram].tolist()) for c, g in zip(pdf["cid"], pdf["grams"])}
        pdf = pdf.assign(words=pdf["bits"].map(len)).sort_values(["words", "n", "cid"])
        kinds = {w: (g["cid"].to_numpy(), g["n"].to_numpy(), g["part"].to_numpy(), g["block"].to_numpy(), np.stack(g["bits"].to_numpy()).view(_U))
                 for w, g in pdf.groupby("words")}
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w, (cid, n, part, block, bits) in kinds.items():
            for v, (o_cid, o_n, o_part, o_block, o_bits) in kinds.items():
                if v < w or n.max() * den < num * o_n.min():
                    continue
                o_bits = fold_bits(o_bits, w)
                strip = max(1, (1 << 22) // (len(o_cid) * w))
                for at in range(0, len(cid), strip):
                    i, j = np.nonzero((part[at : at + strip, None] != o_part) & (np.minimum(n[at : at + strip, None], o_n) * den >= num * np.maximum(n[at : at + strip, None], o_n)))
                    i += at
                    keep = (cid[i] < o_cid[j]) if v == w else np.ones(len(i), bool)
                    if lo != hi:
                        keep &= block[i] != o_block[j]
                    i, j = i[keep], j[keep]
                    differ = np.bitwise_count(bits[i] ^ o_bits[j]).sum(1, dtype=np.int64)
                    near = (num + den) * differ <= (den - num) * (n[i] + o_n[j])
                    a, b = cid[i[near]], o_cid[j[near]]
                    new = np.array([earlier[x].isdisjoint(earlier[y]) for x, y in zip(a.tolist(), b.tolist())], bool)
                    left.append(np.minimum(a, b)[new])
                    right.append(np.maximum(a, b)[new])
        return pd.DataFrame({"k": np.concatenate(left), "o": np.concatenate(right)})

    return run


def _verify(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, text: str, id: str) -> DataFrame:
    """Those of the pairs (k, o) of classes that are similar."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("k").alias("cid")).union(pairs.select("o")).distinct()
    filter_ = spark.sparkContext.broadcast(bloom_words(wanted, "cid", SET_FILTER))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        for batch in batches:
            for _, sets in set_slices(words, batch.column(2), k):
                cids = np.array([class_of(s) for s in sets], np.int64)
                use = [i for i in np.flatnonzero(bloom_has(filter_.value, cids)).tolist() if len(sets[i])]
                if use:
                    values = np.concatenate([sets[i] for i in use]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cids[use]), list_array(values, [len(sets[i]) for i in use])], ["cid", "grams"])

    sets = _read(docs, text, id).mapInArrow(read, "cid long, grams array<long>").groupBy("cid").agg(F.first("grams").alias("grams"))
    sets = cut_lineage(sets, "sets")
    theirs = pairs.join(sets, pairs["o"] == sets["cid"]).select("k", "o", "grams")
    own = sets.join(pairs.select("k").distinct(), sets["cid"] == F.col("k")).select("k", F.lit(None).cast("long").alias("o"), "grams")
    together = theirs.union(own).repartition("k").sortWithinPartitions("k", F.col("o").asc_nulls_first())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"k": None, "own": None, "names": [], "sets": []}

        def search() -> list[int]:
            tree = PrefixTree(state["sets"])
            out = [state["names"][i] for i in tree.similar(state["own"], num, den)]
            state["names"], state["sets"] = [], []
            return out

        for batch in batches:
            left, right = [], []
            grams = batch.column(2)
            values, offsets = grams.values.to_numpy().view(_U), grams.offsets.to_numpy()
            for i, (key, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                mine = values[offsets[i] : offsets[i + 1]]
                if key != state["k"] or len(state["names"]) >= TREE_SETS:
                    if state["names"]:
                        hits = search()
                        left += [state["k"]] * len(hits)
                        right += hits
                    state["k"] = key
                if name is None:
                    state["own"] = mine.copy()
                else:
                    state["names"].append(name)
                    state["sets"].append(mine.copy())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])
        if state["names"]:
            hits = search()
            yield pa.RecordBatch.from_arrays([pa.array([state["k"]] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["u", "v"])

    return together.mapInArrow(walk, "u long, v long")


def link_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(id, h, n_shingles, part, component_id) for every row; h is the text's hash, part one of its component.

    Components only: links between sets that are in one component already are not all computed, nor counted.
    Sets link when den * |overlap| >= num * |union|. The component's id is the smallest id of its rows. A
    text without words, null included, has no n-grams, links with nothing and is a component of its own;
    rows that repeat a text or an id are rows of their own; a null id is the component's only where there is no
    other; an empty table gives no rows; further columns are ignored. Sets and n-grams are compared
    by 64-bit hashes.
    """
    rows = cut_lineage(_sets_table(docs, k, num, den, text, id), "ngram-sets")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("id").alias("m"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = cut_lineage(classes, "ngram-classes")
    common = (classes.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") > crowd)
              .orderBy(F.col("times").desc(), "gram").limit(COMMON).toArrow())
    heads = classes.select("cid", "n", "prefix")
    if common.num_rows:
        later = _reordered(docs, common, k, num, den, text, id).groupBy("cid").agg(F.first("prefix").alias("later"))
        heads = heads.join(later, "cid", "left").select("cid", "n", F.coalesce("later", "prefix").alias("prefix"))

    meeting = heads.select(F.explode("prefix").alias("gram"), "n", "cid").repartition("gram").sortWithinPartitions("gram", "n", "cid")
    met = cut_lineage(meeting.mapInArrow(_meet(num, den, crowd), "k long, o long, gram long, n long, times long"), "ngram-met")
    enough = F.least(F.lit(SHARED), F.ceil(F.lit(num) * F.min("n") / F.lit(den)))
    pairs = met.where("o IS NOT NULL").groupBy("k", "o").agg(F.sum("times").alias("times"), enough.alias("enough")).where("times >= enough")
    one, other = classes.select(F.col("cid").alias("k"), "n", F.col("bits").alias("a")), classes.select(F.col("cid").alias("o"), F.col("n").alias("o_n"), F.col("bits").alias("b"))
    pairs = cut_lineage(pairs.select("k", "o").join(one, "k").join(other, "o").where(can_be_similar(num, den)).select("k", "o"), "ngram-pairs")
    links = cut_lineage(_verify(docs, pairs, k, num, den, text, id), "ngram-links")
    parts = connected_components(links)

    crowds = met.where("gram IS NOT NULL").select("gram", F.col("k").alias("cid"), "n")
    if not crowds.isEmpty():
        named = crowds.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid")).drop("component")
        torn = (named.groupBy("gram", "part").agg(F.count("*").alias("c")).groupBy("gram")
                .agg(F.count("*").alias("parts"), F.sum("c").alias("rows")).where("parts > 1").drop("parts"))
        # Pairs of different parts are held against each other in blocks, each pair of blocks in a task of its own.
        blocks = F.ceil(F.col("rows") / CROWD_BLOCK).cast("int")
        met_at = cut_lineage(named.join(torn, "gram"), "ngram-torn")
        crowds_of = met_at.groupBy("cid").agg(F.collect_set("gram").alias("grams"))  # at most a set's first n-grams
        placed = (met_at.join(crowds_of, "cid").join(classes.select("cid", "bits"), "cid").withColumn("block", F.pmod(F.hash("cid"), blocks))
                  .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))))
        placed = placed.select("gram", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid", "n", "part", "bits", "grams")
        more = placed.groupBy("gram", "lo", "hi").applyInPandas(_apart(num, den), "k long, o long").distinct()
        known = pairs.select(F.greatest("k", "o").alias("g"), F.least("k", "o").alias("l"))
        more = cut_lineage(more.join(known, (F.greatest("k", "o") == F.col("g")) & (F.least("k", "o") == F.col("l")), "left_anti"), "ngram-more")
        if not more.isEmpty():
            links = links.union(cut_lineage(_verify(docs, more, k, num, den, text, id), "ngram-links"))
            parts = connected_components(links)

    joined = classes.select("cid", "m").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    names = joined.groupBy("part").agg(F.min("m").alias("component_id"))
    named = joined.join(names, "part").select(F.col("cid").alias("c"), "part", "component_id")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(named, rows["cid"] == named["c"], "left").select(
        F.col("id").alias(id), "h", F.col("n").alias("n_shingles"), "part", component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, and its own columns only.

    A row without words stays. Only rows that may go move to meet the decision."""
    found = cut_lineage(link_components(docs, k, num, den, text, id).where("part IS NOT NULL").select(F.col(id).alias("id"), "h", "part"), "ngram-parts")
    first = found.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    marks = cut_lineage(found.join(first, "part").select("id", "h", stays.alias("stays")).distinct(), "ngram-marks")

    flag, hash_, number = fresh(docs, "_maybe", "_h", "_n")
    rows = split_rows(docs, marks, text, id, [docs[c] for c in docs.columns], flag)
    late = rows.where(F.col(flag)).withColumn(hash_, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    marks = marks.select(F.col("id").alias("m_id"), F.col("h").alias("m_h"), F.col("stays").alias("m_stays"))
    met = late.join(marks, late[id].eqNullSafe(marks["m_id"]) & (late[hash_] == marks["m_h"]), "left")
    met = met.where(F.coalesce("m_stays", F.lit(True))).withColumn(number, F.row_number().over(W.partitionBy(id, hash_).orderBy(hash_)))
    kept = met.where(F.col("m_stays").isNull() | (F.col(number) == 1))
    return rows.where(~F.col(flag)).select(*docs.columns).union(kept.select(*docs.columns))


@query("op3_prefix_tree_join")
def op3(spark, sf_dir):
    """Near copies among all documents: four-word n-grams, similarity 0.85."""
    return link_components(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")
