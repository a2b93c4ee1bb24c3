"""URL verdicts: a blocked Bloom filter of the listed URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.common import query, table
from gatewise.session import cut_lineage

#: Listed rules of the query. Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Blocks of 512 bits. The filter is at most MAX_BLOCKS * 72 bytes, hence safe to broadcast; a longer
#: list of URLs only makes it let more through to the exact join.
MAX_BLOCKS = 1 << 16
URLS_PER_BLOCK = 32
WORDS = 8
#: Parts that the pages of one address are dealt over.
PARTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path without query and fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _bits(key: str) -> list[str]:
    """SQL for the words of a block that hold a key's eight bits: one bit in each word."""
    return [f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, {i}), 20) & 63 as int))" for i in range(WORDS)]


def _block(key: str, n: int) -> str:
    return f"cast(pmod(xxhash64({key}), {n}) as int)"


def bloom(rules: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as rows (block, w0 .. w7), from a column ``key``."""
    bits = [F.bit_or(F.expr(b)).alias(f"w{i}") for i, b in enumerate(_bits("key"))]
    return rules.groupBy(F.expr(_block("key", n_blocks)).alias("block")).agg(*bits)


def _passes(key: str) -> Column:
    """Whether a row joined with its block of the filter has all bits of its key; false without a block."""
    return F.coalesce(F.expr(" and ".join(f"(w{i} & {b}) = {b}" for i, b in enumerate(_bits(key)))), F.lit(False))


def _blocks(n_keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-n_keys // URLS_PER_BLOCK)))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path (from its ``/``) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; of several the one with
    the longest host wins, then the longest path. Without one the URL is not listed and ``default``
    stands. Each URL yields one key for every number of host labels and length of path that the rules
    have. Keys that the filter stops end in the task that reads them; the others meet the rules in a hash join, which
    alone decides, and each host and path with a rule is told once. A second filter, of those, spares the pages without
    a rule the way to that table. A null URL has an empty host and path, long URLs are judged whole, repeated rows stay,
    an empty table of pages gives no rows and one of rules the default; columns of the pages that clash are replaced.
    """
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path")), F.count("*")).first()
    labels, lengths = sorted(shape[0]), sorted(shape[1])
    n_blocks = _blocks(shape[2])
    listed = rules.select(F.concat("host", "path").alias("key"), F.struct(F.length("host").alias("h"), F.length("path").alias("p"), "host", "path", "verdict").alias("hit")).distinct()

    host, path = host_and_path(pages[url])
    hosts = F.array_distinct(F.array(*[F.substring_index("_host", ".", -n) for n in labels])) if labels else F.array().cast("array<string>")
    paths = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("_path", 1, n).alias("s")) for n in lengths]),
                     lambda x: F.length(x["s"]) == x["n"]) if lengths else F.array().cast("array<struct<n:int,s:string>>")
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p["s"]))))
    probes = (pages.select(host.alias("_host"), path.alias("_path")).withColumn("key", F.explode(keys))
              .withColumn("block", F.expr(_block("key", n_blocks))))
    maybe = probes.join(F.broadcast(bloom(listed, n_blocks)), "block").where(_passes("key")).select("_host", "_path", "key")
    judged = cut_lineage(maybe.join(listed, "key").groupBy("_host", "_path").agg(F.max("hit").alias("hit")), "judged")

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    n_judged = _blocks(judged.count())
    known = bloom(judged.select(F.concat_ws("\u0000", "_host", "_path").alias("key")), n_judged)
    read = pages.select(F.struct(*[pages[c] for c in kept]).alias("_page"), host.alias("_host"), path.alias("_path"))
    read = read.withColumn("key", F.concat_ws("\u0000", "_host", "_path")).withColumn("block", F.expr(_block("key", n_judged)))
    read = read.join(F.broadcast(known), "block", "left").select("_page", "_host", "_path", _passes("key").alias("_known"))
    # One address may hold a third of all pages: its pages are dealt over parts, each with a copy of its rule. The copies
    # grow with the pages and are more than their file's size tells, so they are never broadcast.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
    copies = judged.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge")
    met = read.where("_known").withColumn("_part", part).join(copies, ["_host", "_path", "_part"], "left").select("_page", "_host", "_path", "hit")
    rest = read.where("NOT _known").select("_page", "_host", "_path", F.lit(None).cast(judged.schema["hit"].dataType).alias("hit"))
    return met.union(rest).select("_page.*", F.col("_host").alias("host"), F.col("_path").alias("path"),
                                  F.concat("hit.host", "hit.path").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def _rules_sql() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


ORACLE = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_rules_sql()}),
rest AS (SELECT page_id, row_number() OVER () AS n,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, n, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
    FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


@query("op10_url_filter", ORACLE)
def op10(spark, sf_dir):
    """Every page's URL against the listed rules."""
    rules = spark.sql(f"SELECT * FROM VALUES {_rules_sql()} AS t(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
