"""Collocations, spelling variants and toxicity against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.llm import collocations, spelling, toxicity

# ---- collocations -----------------------------------------------------------------------------------------


def plain_collocations(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        ok = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        gone = {q[i:j] for q, b in ok.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                if j - i < len(q) and b >= f[q[i:j]]}
        scored = []
        for p, a in ok.items():
            if p not in gone:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def test_collocations_match_plain_python(docs, rows):
    want = plain_collocations([(r[1], r[2]) for r in rows], 3, 5, 300)
    got = sorted(map(tuple, collocations.collocations(docs, least=3, top=300).collect()))
    assert got == want and len({r[0] for r in got}) > 1 and max(len(r[2].split(" ")) for r in got) == 5


def test_collocations_of_pieces_overlaps_and_languages(spark):
    texts = [("a a a a. B\tb,b b", "x"), ("a a a\na a", "x"), ("a a a", None), ("c d!c d?c d:c d;c  d", ""), ("É é É é", "x")] * 4
    df = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    got = sorted(map(tuple, collocations.collocations(df, least=4).collect()))
    assert got == plain_collocations(texts, 4, 5, 2000)


def test_collocation_scores_pass_64_bits(spark):
    row = spark.range(1).select(collocations._score(F.lit(4 * 10**12), F.lit(9 * 10**15), F.lit(10**15), F.lit(3)).alias("s")).first()
    assert row["s"] == 1000 * 4 * 10**12 * 9 * 10**15 // (3 * 10**15)


def test_no_phrase_at_all(no_docs, docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(docs.where("text IS NULL OR text = ''")).count() == 0


# ---- spelling ---------------------------------------------------------------------------------------------


def plain_spelling(rows, least_chars, least, noise, ratio=5):
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % noise == 0 else low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, []
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        forms[w] = (best if best is not None and words[best] >= ratio * n else None, len(close))
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, words[w], n_near, words[form] if form else None))
    return sorted(out, key=lambda r: r[0])


def got_words(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_spelling_matches_plain_python(docs, rows):
    want = plain_spelling([(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 100_000], 4, 3, 7)
    got = got_words(spelling.spelling_groups(docs.where("text IS NULL OR length(text) < 100000"), least_chars=4, least=3, noise=7))
    assert got == want and any(r[1] for r in got)


def test_spelling_chains_ties_and_accents(spark):
    r = random.Random(4)
    base = ["aaaaaa", "abcdef", "élèves", "straße", "banana", "anbana"]
    text = []
    for w in base:
        forms = {w: 125, w[:-1] + "x": 25, w[:-1] + "xy": 5, "z" + w: 5, w[1:] + "q": 5, w[:2] + w[3:] + "ab": 6}
        forms |= {w[:i] + r.choice("aé") + w[i:]: 5 for i in range(len(w))}
        for v, n in forms.items():
            text += [v] * n
    r.shuffle(text)
    rows = [(i, " ".join(text[i::6])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = got_words(spelling.spelling_groups(df))
    assert got == plain_spelling(rows, 6, 5, 199)
    chain = {w: (form, root) for w, form, root, *_ in got}
    assert chain["abcdexy"] == ("abcdex", "abcdef")


def test_spelling_of_odd_tables(spark, no_docs, docs):
    assert spelling.spelling_groups(no_docs).count() == 0
    assert spelling.spelling_groups(docs.where("text IS NULL")).count() == 0
    big = spark.createDataFrame([(None, "ab" * 100_000 + " hellos " * 6), (None, None)], "doc_id long, text string")
    assert got_words(spelling.spelling_groups(big)) == [("hellos", None, "hellos", 6, 0, None)]


def test_pivots_are_disjoint_and_cheapest():
    r = random.Random(1)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(4, 9))) for _ in range(500)}
    held = Counter()
    for w in words:
        held.update({w[i : i + 2] for i in range(len(w) - 1)})
    for w in words:
        prefix = spelling.prefix_grams(w, held)
        a, b = spelling.pivot_grams(prefix)
        assert a[2] + 2 <= b[2] and a in prefix and b in prefix
        assert a[0] + b[0] == min(x[0] + y[0] for x in prefix for y in prefix if x[2] + 2 <= y[2])


# ---- toxicity ---------------------------------------------------------------------------------------------


def plain_patterns(clause, insults):
    """Patterns of a clause of plain words: {kind: strength}."""
    classes = {**dict.fromkeys(toxicity.NEGATIONS.split(), "neg"), **dict.fromkeys(toxicity.REPORTS.split(), "rep"),
               **dict.fromkeys(toxicity.TARGETS.split(), "aim"), **dict.fromkeys(toxicity.THREATS.split(), "threat")}
    kinds, found, reported = [classes.get(w, "bad" if w in insults else "") for w in clause], [], False
    for i, kind in enumerate(kinds):
        near = kinds[max(0, i - toxicity.REACH) : i]
        reported |= kind == "rep"
        if kind in ("bad", "threat"):
            weight = insults.get(clause[i], 1.0) if kind == "bad" else 1.0
            if "neg" in near:
                found.append([toxicity.DENIED, weight, i, False])
            elif reported:
                found.append([toxicity.REPORTED, weight, i, False])
            elif kind == "threat":
                found.append([toxicity.THREAT, weight, i, False])
            else:
                found.append([toxicity.AIMED if "aim" in near else toxicity.INSULT, weight, i, True])
        elif kind == "aim" and found and found[-1][0] == toxicity.INSULT and i - found[-1][2] <= toxicity.REACH:
            found[-1][0] = toxicity.AIMED
    return [max((w for k, w, *_ in found if k == kind), default=0.0) for kind in toxicity.KINDS]


def matcher(insults):
    keys = np.concatenate([toxicity.word_entries(w) for w in insults]) if insults else np.zeros(0, np.uint64)
    lexicon = toxicity.Lexicon(keys, np.full(len(keys), 9), np.zeros(len(keys)), 10, 10)
    order = {k: w for k, w in zip(keys.tolist(), insults.values())}
    lexicon.weight = np.array([order[k] for k in lexicon.keys.tolist()])
    return toxicity.Matcher(lexicon)


def strengths(m, text):
    import pyarrow as pa

    data = np.frombuffer(toxicity.lowered(pa.array([text]))[0].as_py().encode(), np.uint8)
    return m.strengths(data, np.array([0, len(data)]))[0].tolist()


def test_grammar_reads_clauses():
    insults = {"gork": 2.0, "blap": 3.0}
    m = matcher(insults)
    r = random.Random(2)
    pool = ["gork", "blap", "you", "not", "said", "kill", "tree", "sun", "and", "du", "no"]
    for _ in range(400):
        clauses = [[r.choice(pool) for _ in range(r.randint(1, 9))] for _ in range(r.randint(1, 3))]
        want = np.sum([plain_patterns(c, insults) for c in clauses], axis=0).tolist()
        assert strengths(m, ". ".join(" ".join(c) for c in clauses))[:-1] == pytest.approx(want), clauses


def test_grammar_examples():
    m = matcher({"gork": 2.0})
    kind = dict(zip(("plain", "aimed", "denied", "reported", "threat"), range(5)))
    for text, name in [("What a GORK", "plain"), ("you utter gork", "aimed"), ("gork, that you are", "plain"), ("gork that you are", "aimed"),
                       ("she is not a gork", "denied"), ("he said a gork", "reported"), ("a “gork” he is", "reported"), ("we will burn it", "threat")]:
        assert [i for i, v in enumerate(strengths(m, text)[:-1]) if v] == [kind[name]], text
    assert strengths(m, "")[:-1] == [0] * 5


def toxic_table(spark, n=400):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 60))]
        bad = i % 5 == 0
        for _ in range(4 * bad):
            words.insert(r.randrange(len(words)), r.choice(["vorlump", "vorlumpig", "vorlumpen", "zwackel"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def held_out(id_):
    return id_ is None or zlib.crc32(str(id_).encode()) % 4 == 2


def test_toxicity_is_learned_from_the_other_folds(spark):
    docs, labels = toxic_table(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r["held_out"] == held_out(i) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert sum(r["predicted"] != (i % 5 == 0) for i, r in got.items() if r["held_out"]) == 0
    # Labels of the held-out fold change nothing.
    code = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    turned = labels.withColumn("toxic", F.when(code == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, turned).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in got.items()})


def test_entry_counts_match_plain_python(spark):
    docs, labels = toxic_table(spark, 60)
    rows = docs.join(labels, "doc_id").select("text", F.col("toxic").cast("double").alias("label"))
    want = Counter()
    for r in rows.collect():
        entries = set()
        for w in r["text"].split():
            entries |= {("whole", w)} | {("stem", w[:n]) for n in toxicity.STEMS if len(w) > n}
        want.update((e, r["label"]) for e in entries)
    by_entry = defaultdict(lambda: [0, 0])
    for (e, y), n in want.items():
        by_entry[e][y == 0] += n
    got = sorted((r["p"], r["n"]) for r in toxicity._count_entries(rows).collect())
    assert got == sorted(map(tuple, by_entry.values()))


def test_toxicity_of_odd_rows(docs, no_docs, rows):
    from pyspark.sql import functions as F

    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.score_toxicity(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    unlabelled = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert all(r["predicted"] == 0 for r in unlabelled)


def test_patterns_are_fitted_by_logistic_regression():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + x @ [2.0, -1.0])))).astype(float)
    bias, weights = toxicity.fit_patterns(x, y, ridge=1e-6)
    assert abs(bias - 0.5) < 0.2 and abs(weights - [2.0, -1.0]).max() < 0.25
