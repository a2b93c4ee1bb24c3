"""Operators on documents against plain Python, on rows with every odd case, and on none."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.llm import mixing, ngram_join, packing, quality, sharding, substring, tokens


def some(x):
    return (x is None, x or 0)


def test_shards_are_even_and_gapless(docs, rows):
    out = sharding.histogram_shards(docs, 4, carry=("text",)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    for r in out:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    shards = brute.by(out, lambda r: r.shard)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    assert all(abs(sum(r.size for r in shards.get(i, [])) - total / 4) <= largest for i in range(4))
    split = [t for t, g in brute.by(out, lambda r: r.text).items() if len({r.shard for r in g}) > 1]
    assert len(split) <= 3  # equal texts part only at a boundary


def test_shards_cut_a_crowd_of_copies(spark):
    crowd = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.histogram_shards(crowd, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 40


def test_shard_folders_hold_all_rows(docs, rows, spark, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r[0] for r in back.select("shard").distinct().collect()} <= {0, 1, 2}


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    want = sorted((some(r[0]), len((r[1] or "").encode()), len(own.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = tokens.token_counts(docs).collect()
    assert sorted((some(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n\nb c", "a\tb c", "it's we'll  x", "a\u00a0b c", "a <|endoftext|> b", "x\n y", "x \ny", "\n", "a\r\nb c d\n", "1 2 3 !!  ??"])
def test_pieces_have_the_ids_of_the_whole(text):
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):  # new and remembered
        assert np.frombuffer(next(encoder.encode([text])), np.uint32).tolist() == want


@pytest.mark.parametrize("text", ["word, (word). word! word", "a, b1; é. ª, ʼn! Ⅳ, 12% a's, don'. x", "a\nb,\nc. d", "<|endoftext|>, a<|endoftext|>. b|> <|endoftext, c",
                                  "中, ɐ. ñ1- _a_ a_b", "a,' b'. c,s d's,"])
def test_words_with_what_ends_them(text):
    test_pieces_have_the_ids_of_the_whole(text)


def test_a_word_is_encoded_once_whatever_ends_it():
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    list(encoder.encode(["x word word, word. word; word! word?"]))
    assert [w for w in encoder.words if "word" in w] == [" word"]
    direct = encoder.tokenizer.encode_batch([" word", ","], add_special_tokens=False)
    assert np.frombuffer(encoder.memory["word,"], np.uint32).tolist() == [i for e in direct for i in e.ids]


def test_near_copies(docs, rows):
    for k, num in ((4, 85), (5, 80)):
        got = sorted(((some(r.doc_id), r.n_shingles, some(r.component_id)) for r in ngram_join.link_components(docs, k, num, 100).collect()))
        assert got == sorted((some(a), n, some(c)) for a, n, c in brute.near_copies([r[:2] for r in rows], k, num, 100))


def test_near_copies_in_crowds(docs, rows):
    """Every n-gram group counts as a crowd: few pairs first, then those that are still apart."""
    got = sorted((some(r.doc_id), r.n_shingles, some(r.component_id)) for r in ngram_join.link_components(docs, 4, 85, 100, crowd=2).collect())
    assert got == sorted((some(a), n, some(c)) for a, n, c in brute.near_copies([r[:2] for r in rows], 4, 85, 100))


def test_prefix_tree_finds_what_comparing_finds():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 30, draw.integers(1, 25)).astype(np.uint64)) for _ in range(200)]
    tree = ngram_join.PrefixTree(sets)
    for query in sets[:60]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(query, s)) >= 70 * len(np.union1d(query, s))]
        assert sorted(tree.similar(query, 70, 100)) == want


def test_one_of_each_group_stays(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((some(r.doc_id), r.text or "") for r in kept.collect()))
    found = brute.near_copies([r[:2] for r in rows], 5, 80, 100)
    want, seen = [], set()
    for (id_, n, part), r in zip(found, rows):
        if n and part is not None:
            if id_ != part or part in seen:
                continue
            seen.add(part)
        want.append((some(id_), r[1] or ""))
    assert got == sorted(want)


def test_repeated_passages(docs, rows):
    want = sorted((some(a), n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for a, kept, n in brute.without_repeats([r[:2] for r in rows], 13))
    got = sorted((some(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(docs).collect())
    assert got == want


@pytest.mark.parametrize("vocabulary", [2, 3, 40])
def test_repeated_passages_of_few_words(spark, vocabulary):
    """Anchors that occur many times in a document, in many contexts, take several rounds of extension."""
    r = random.Random(vocabulary)
    rows = [(i, " ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 60)))) for i in range(60)]
    shared = rows[5][1] + " " + " ".join(f"w{r.randrange(vocabulary)}" for _ in range(14))
    rows += [(60 + i, f"w{i % vocabulary} {shared} w{i % 3}") for i in range(12)] + [(None, shared), (7, shared)]
    want = sorted((some(a), n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for a, kept, n in brute.without_repeats(rows, 13))
    got = substring.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((some(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == want


def test_passages_leave_the_texts(docs, rows):
    out = substring.strip_repeats(docs)
    assert out.columns == docs.columns
    want = []
    for (id_, kept, n), r in zip(brute.without_repeats([r[:2] for r in rows], 13), rows):
        if kept or not n:
            want.append((some(id_), (r[1] or "") if len(kept) == n else b" ".join(kept).decode()))
    assert sorted((some(r.doc_id), r.text or "") for r in out.collect()) == sorted(want)


def test_mixture_meets_its_targets(docs, rows):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (some(r.doc_id), r.text_hash, r.occurrence, r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert len(out) == len(rows)
    sizes = {s: sum(len(brute.words(r[1])) for r in g) for s, g in brute.by(rows, lambda r: r[3]).items()}
    target = brute.mix_targets(sizes)
    for source, part in brute.by(out, lambda r: r.source).items():
        assert part[0].source_size == sizes[source] and abs(part[0].target - target[source]) < 1e-6
        assert all(0 <= r.copies <= 2 for r in part)
        assert abs(sum(r.size * r.copies for r in part) - target[source]) <= max(r.size for r in part)


def test_rounding_keeps_each_chance(spark):
    """Over many strata a row's rate of selection is its probability, and each stratum's sum is kept."""
    rows = spark.range(40_000).select(
        (F.col("id") % 1000).cast("string").alias("stratum"), F.struct("id").alias("k"), (1 + F.floor(F.col("id") / 1000) % 7).alias("s"), F.lit(0.3).alias("p"))
    out = mixing.pivotal_rounding(rows, block=8).join(rows, ["stratum", "k"]).select("stratum", "s", "extra").toPandas()
    assert len(out) == 40_000
    taken, whole = (out["s"] * out["extra"]).groupby(out["stratum"]).sum(), out["s"].groupby(out["stratum"]).sum() * 0.3
    assert (taken - whole).abs().max() <= 7
    assert (out.groupby("s")["extra"].mean() - 0.3).abs().max() < 0.03


def test_copies_are_rows(docs, rows):
    out = mixing.take(docs)
    assert out.columns == docs.columns
    drawn = mixing.mix(docs).collect()
    want = sum(r.copies for r in drawn)
    assert out.count() == want


@pytest.mark.parametrize("with_words", [True, False])
def test_sources_without_words_are_taken_once(spark, with_words):
    silent = [(0, None, "a"), (1, "", "b"), (2, " \n", "b"), (3, None, None), (3, None, None)]
    spoken = [(10 + i, "one two three " * (1 + i % 4), "cd"[i % 2]) for i in range(30)] if with_words else []
    docs = spark.createDataFrame(silent + spoken, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(silent) + len(spoken)
    none = [r for r in out if r.source not in ("c", "d")]
    assert len(none) == len(silent) and all((r.size, r.source_size, r.target, r.copies) == (0, 0, 0.0, 1) for r in none)
    sizes = {s: sum(len(brute.words(r[1])) for r in g) for s, g in brute.by(silent + spoken, lambda r: r[2]).items()}
    target = brute.mix_targets(sizes)
    for source, part in brute.by(out, lambda r: r.source).items():
        assert part[0].source_size == sizes[source] and abs(part[0].target - target[source]) < 1e-6
        assert abs(sum(r.size * r.copies for r in part) - target[source]) <= max(r.size for r in part)
    taken = sorted(((r.doc_id, r.text, r.source) for r in mixing.take(docs).collect()), key=str)
    assert [r for r in taken if r[2] not in ("c", "d")] == sorted(silent, key=str)
    assert len(taken) == sum(r.copies for r in out)


def test_packing_covers_every_id_once(docs, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    out = packing.pack(docs).collect()
    assert sum(r.length for r in out) == sum(len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    ids = {r[0]: own.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows if r[0] is not None}
    repeated = {rows[25][0], rows[60][0], None}
    for id_, part in brute.by(out, lambda r: r.doc_id).items():
        if id_ in repeated:
            continue
        at, whole = 0, np.array(ids[id_], np.uint32)
        for r in sorted(part, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    bins = brute.by(out, lambda r: r.sequence_id)
    assert sorted(bins) == list(range(len(bins)))
    for part in bins.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert 1 - sum(r.length for r in out) / (2048 * len(bins)) < 0.05


@pytest.mark.parametrize("length", [1, 2, 3, 600, 683, 1023, 1024, 1025, 1500, 2047, 2048, 2049, 10_000])
def test_cuts_fit_their_classes(length):
    pieces = packing.cuts(length)
    assert sum(n for n, _ in pieces) == length
    assert all(0 < n * k <= 2048 for n, k in pieces)


def test_short_pieces_have_their_own_classes():
    assert [packing.cuts(n) for n in range(1, 33)] == [[(n, 2048 // n)] for n in range(1, 33)]


def test_short_texts_fill_their_sequences(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (6 + F.col("id") % 6).cast("int")), lambda i: F.lit("the")))
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), words.alias("text"))
    out = packing.pack(docs).collect()
    assert len(out) == 8000 and max(r.length for r in out) < 32
    bins = brute.by(out, lambda r: r.sequence_id)
    assert sorted(bins) == list(range(len(bins)))
    for part in bins.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert 1 - sum(r.length for r in out) / (2048 * len(bins)) < 0.05


def test_quality_scores(docs, rows, spark):
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(rows)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    machine = quality.train(docs, labels, metadata=("n_chars",))
    out = quality.with_score(docs, machine, "own_score", metadata=("n_chars",)).select("doc_id", "own_score").collect()
    assert len(out) == len(rows) and all(0 <= r.own_score <= 1 for r in out)
    kept = quality.keep_good(docs, labels, metadata=("n_chars",))
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    none = quality.train(docs, labels.limit(0))
    assert {r[0] for r in quality.with_score(docs, none, "s").select("s").collect()} == {0.5}


def test_interactions_equal_all_pairs():
    machine = quality.Machine(2)
    index, x = np.array([5, 9, 100]), np.array([0.5, 1.0, 2.0])
    value = machine.raw(index, x, np.array([0]))[0][0]
    pairs = sum(float(machine.factors[index[i]] @ machine.factors[index[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(value - pairs) < 1e-5


@pytest.mark.parametrize("operator", [
    lambda d: sharding.histogram_shards(d, 8), tokens.token_counts, lambda d: ngram_join.link_components(d), ngram_join.keep_one, substring.digest,
    substring.strip_repeats, mixing.mix, mixing.take, packing.pack])
def test_no_documents(no_docs, operator):
    assert operator(no_docs).collect() == []


def test_parities_never_tell_similar_sets_apart():
    draw = np.random.default_rng(2)
    for size in (1, 3, 40, 64, 65, 200, 900):
        a = np.unique(draw.integers(0, 1 << 62, size).astype(np.uint64))
        b = np.union1d(a[draw.random(len(a)) < 0.9], draw.integers(0, 1 << 62, size // 6 + 1).astype(np.uint64))
        x, y = ngram_join.parity_bits(a)[None], ngram_join.parity_bits(b)[None]
        words = min(x.shape[1], y.shape[1])
        differ = np.bitwise_count(ngram_join.fold_bits(x, words) ^ ngram_join.fold_bits(y, words)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_sql_folds_bits_alike(spark):
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64)) for n in (50, 70, 130, 250, 260)]
    rows = [(len(a), ngram_join.parity_bits(a).view(np.int64).tolist(), len(b), ngram_join.parity_bits(b).view(np.int64).tolist()) for a in sets for b in sets]
    df = spark.createDataFrame(rows, "n long, a array<long>, o_n long, b array<long>")
    got = [r[0] for r in df.select(ngram_join.can_be_similar(85, 100)).collect()]
    want = []
    for a in sets:
        for b in sets:
            x, y = ngram_join.parity_bits(a)[None], ngram_join.parity_bits(b)[None]
            words = min(x.shape[1], y.shape[1])
            differ = int(np.bitwise_count(ngram_join.fold_bits(x, words) ^ ngram_join.fold_bits(y, words)).sum())
            want.append(185 * differ <= 15 * (len(a) + len(b)))
    assert got == want
