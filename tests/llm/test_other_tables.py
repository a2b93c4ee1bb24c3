"""Vectors and URLs against plain Python, on odd rows and on none."""

import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.llm import embedding_dedup, topk, url_filter


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(16).tolist()) for i in range(300)]
    rows += [(300 + i, (np.array(rows[7][1]) + 0.02 * draw.standard_normal(16)).tolist()) for i in range(30)]
    rows += [(400 + i, rows[11][1]) for i in range(12)] + [(500, (2 * np.array(rows[12][1])).tolist())]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [float("inf")] + [1.0] * 15), (604, [None] + [1.0] * 15), (605, [])]
    rows += [(None, rows[7][1]), (None, [3.0] * 16), rows[20], rows[20], (20, rows[21][1])]
    return rows


@pytest.fixture(scope="module")
def items(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "vec", "w", "id", "leaf", "k")})


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def near(vectors):
    fine = [good(v) and any(v) for _, v in vectors]
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(vectors, fine)]
    links = [(j, i) for i in range(len(vectors)) for j in range(i) if fine[i] and fine[j] and float(unit[i] @ unit[j]) >= 0.9 - 1e-12]
    part, count = brute.groups(len(vectors), links), [0] * len(vectors)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    least = {}
    for (id_, _), p in zip(vectors, part):
        if id_ is not None:
            least[p] = min(id_, least.get(p, id_))
    return sorted((str(id_), n, str(least.get(p, id_)), id_ is not None and id_ == least.get(p, id_)) for (id_, _), n, p in zip(vectors, count, part))


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 40, "block_rows": 8}])
def test_near_vectors(items, vectors, options):
    out = embedding_dedup.near_duplicates(items, **options).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out) == near(vectors)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold are the hardest for the trees to keep together."""
    draw = np.random.default_rng(9)
    a = draw.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((4000, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.901 * a + math.sqrt(1 - 0.901**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(df, leaf_rows=128).agg(F.sum("n_links")).first()[0]
    assert found >= 0.9 * 8000


def test_no_vectors(items):
    assert embedding_dedup.near_duplicates(items.limit(0)).collect() == []


@pytest.mark.parametrize("shard_rows,query_rows", [(8192, 4096), (37, 5)])
def test_top_k(items, vectors, shard_rows, query_rows):
    docs = items.select("vec_id", topk.quantized(F.col("embedding")).alias("vector"), "id", "k")
    out = topk.top_k(docs, docs.where("vec_id % 20 = 0"), 7, shard_rows=shard_rows, query_rows=query_rows).collect()
    rows = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in rows:
        if q % 20 == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q]
            want.append((q, sorted(found)))
    merged = {}
    for q, found in want:
        merged.setdefault(q, []).extend(found)
    want = sorted((q, n + 1, i, -s) for q, found in merged.items() for n, (s, i) in enumerate(sorted(found)[:7]))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == want


def test_top_k_of_few(spark):
    docs = spark.createDataFrame([(0, [1, -1]), (1, [-5, 0]), (2, [-2, 0]), (3, [0, 0])], "vec_id long, vector array<bigint>")
    out = topk.top_k(docs, docs.where("vec_id = 0"), 20).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in out) == [(1, 3, 0), (2, 2, -2), (3, 1, -5)]
    assert topk.top_k(docs.limit(0), docs.limit(0), 20).collect() == []
    both = spark.createDataFrame([(0, [1, 0]), (1, [2, 0]), (1, [2, 5]), (1, [2, 5])], "vec_id long, vector array<bigint>")
    out = topk.top_k(both, both.where("vec_id = 0"), 20).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in out) == [(1, 1, 2), (2, 1, 2)]


def judge(url, rules):
    head, mark, rest = (url or "").partition("://")
    rest = rest if mark else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?x=/fr/", "http://example.com/en", "http://example.com/en/",
        "http://a.b.example.com/en/x#y", "http://xexample.com/en/", "http://net/es/", "http://.net/fr/", "http://net./fr/", "http://a.net?/es/", "http://a.net#/es/",
        "http://ÄB.com/İ", "x://y://z.net/es/", "http://com:80/", "http://u@example.com/en/", "http://" + "a." * 3000 + "com/" + "p" * 50_000, "http://a.com//en/", "://net/fr/\nq"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[6]), (5, URLS[5]), (5, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "key", "block", "w0", "_row", "_page", "hit")})
    rules = spark.sql(f"SELECT * FROM VALUES {url_filter._rules_sql()} AS t(host, path, verdict)")
    out = url_filter.judge_urls(pages, rules).collect()
    want = [(str(i), u, *judge(u, url_filter.RULES)) for i, u in rows]
    assert sorted(((str(r.page_id), r.url, r.host, r.path, r.rule, r.verdict) for r in out), key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_filter_passes_every_listed_url(spark):
    """Many listed URLs, over many blocks; the join decides."""
    rules = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(10_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".org/a")).alias("url"))
    out = url_filter.judge_urls(pages, rules).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in out} == {"block": 5000, "allow": 5000}
