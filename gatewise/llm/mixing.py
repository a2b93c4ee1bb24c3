"""Mixing sources to target weights by pivotal dependent rounding.

A document is to be taken ``target / source size`` times, on average. The whole part is certain; the
fraction is the document's probability of one copy more. Two documents of a source are paired and mass is
moved between them at random, in words rather than in documents, until one of them is certain: the words
that the pair takes stay the same and so does each one's chance. The other goes on to the next pair. Blocks
of documents are settled side by side, what each leaves over meets in blocks of the next level, and so on
up the tree; one document a source is left at the end, so the words taken miss the target by no more
than its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.llm.common import WORD, fresh, query, table
from gatewise.session import cut_lineage

#: Weights of the sources in order, repeating. Fixed values.
WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2.0
#: Documents settled one after the other in a block, and residuals that meet in one block above it.
BLOCK = 64
SEED = 20_240_229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target), sources by code point with null last.

    Shares above ``ceiling`` times the source's size are cut there and the excess is shared again by
    weight among the others, until none is above. The sources are one short table: a row for each.
    """
    sizes = docs.groupBy(docs[source].alias("source")).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit(list(weights)), (F.col("r") % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("r", rank).withColumn("w", weight).drop("r")
    # Cutting starts with the source that has most weight for its size: with sources in that order the
    # cut ones come first, and all others get one and the same number of words for each unit of weight.
    # A source of size 0 has no such ratio: it comes first and is cut at 0.
    order = W.orderBy(F.try_divide("w", "source_size").desc_nulls_first(), F.col("source").asc_nulls_last())
    whole = W.partitionBy(F.lit(1))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    placed = (ranked.withColumn("total", F.sum("source_size").over(whole))
              .withColumn("cut", ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
              .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
              .withColumn("level", (share * F.col("total") - F.col("cut")) / F.col("left_w"))
              .withColumn("above", F.col("level") * F.col("w") > ceiling * F.col("source_size")))
    settled = placed.withColumn("level", F.min(F.when(~F.col("above"), F.struct(
        (F.try_divide("w", "source_size") * -1).alias("o"), F.col("level").alias("l")))).over(whole)["l"])
    target = F.least(ceiling * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), ceiling * F.col("source_size")))
    return settled.select("source", "source_size", target.alias("target"))


# A document within a block: its payload, size s and probability p of one more copy.
_STEP = f"""
(acc, e) -> CASE
  WHEN e.p <= 0 OR e.p >= 1 THEN named_struct('open', acc.open, 'done', array_append(acc.done, e))
  WHEN acc.open IS NULL THEN named_struct('open', e, 'done', acc.done)
  ELSE transform(array(named_struct(
      'up', least((1 - acc.open.p) * acc.open.s, e.p * e.s), 'down', least(acc.open.p * acc.open.s, (1 - e.p) * e.s),
      'u', (shiftrightunsigned(xxhash64(acc.open.k, e.k, {SEED}L), 11)) / 9007199254740992.0D)), g ->
    CASE WHEN g.u * (g.up + g.down) < g.down THEN
      CASE WHEN (1 - acc.open.p) * acc.open.s <= e.p * e.s
        THEN named_struct('open', named_struct('k', e.k, 's', e.s, 'p', e.p - g.up / e.s), 'done', array_append(acc.done, named_struct('k', acc.open.k, 's', acc.open.s, 'p', 1.0D)))
        ELSE named_struct('open', named_struct('k', acc.open.k, 's', acc.open.s, 'p', acc.open.p + g.up / acc.open.s), 'done', array_append(acc.done, named_struct('k', e.k, 's', e.s, 'p', 0.0D))) END
    ELSE
      CASE WHEN acc.open.p * acc.open.s <= (1 - e.p) * e.s
        THEN named_struct('open', named_struct('k', e.k, 's', e.s, 'p', e.p + g.down / e.s), 'done', array_append(acc.done, named_struct('k', acc.open.k, 's', acc.open.s, 'p', 0.0D)))
        ELSE named_struct('open', named_struct('k', acc.open.k, 's', acc.open.s, 'p', acc.open.p - g.down / acc.open.s), 'done', array_append(acc.done, named_struct('k', e.k, 's', e.s, 'p', 1.0D))) END
    END)[0] END
"""


def pivotal_rounding(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stratum, k, extra) with ``extra`` 0 or 1, for rows (stratum, k struct, s size over 0, p probability).

    In every stratum sum(s * extra) differs from sum(s * p) by one row's size at most. Reruns agree: blocks,
    order and draws come from hashes of ``k``.
    """
    whole = "named_struct('open', cast(null as struct<k: {k}, s: double, p: double>), 'done', cast(array() as array<struct<k: {k}, s: double, p: double>>))"
    zero = whole.format(k=rows.schema["k"].dataType.simpleString())
    level, settled, size = rows.select("stratum", "k", F.col("s").cast("double").alias("s"), F.col("p").cast("double").alias("p")), None, None
    for depth in range(64):
        counts = level.groupBy("stratum").agg(F.count("*").alias("n"))
        level_blocks = level.join(counts, "stratum").withColumn(  # strata are few, AQE sends the counts along
            "b", F.pmod(F.xxhash64("k", F.lit(depth)), F.ceil(F.col("n") / block)))
        # From large to small, so that what is left open at the end of a block is a small document.
        item = F.struct((-F.col("s")).alias("o"), F.xxhash64("k", F.lit(SEED)).alias("h"), F.struct("k", "s", "p").alias("e"))
        folded = (level_blocks.groupBy("stratum", "b").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("es"), F.first("n").alias("n"))
                  .select("stratum", "n", F.expr(f"aggregate(es, {zero}, {_STEP})").alias("r")))
        folded = cut_lineage(folded, "mix-level")
        done = folded.select("stratum", F.explode("r.done").alias("e"))
        settled = done if settled is None else settled.union(done)
        level = folded.where("r.open IS NOT NULL").select("stratum", "r.open.k", "r.open.s", "r.open.p")
        size = level.groupBy("stratum").count().agg(F.max("count")).first()[0] or 0
        if size <= 1:
            break
    draw = F.expr(f"shiftrightunsigned(xxhash64(k, {SEED}L), 11) / 9007199254740992.0D")
    last = level.select("stratum", F.struct("k", "s", F.when(draw < F.col("p"), 1.0).otherwise(0.0).alias("p")).alias("e"))
    return settled.union(last).select("stratum", "e.k", F.col("e.p").cast("int").alias("extra"))


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(id, occurrence, size, source, source_size, target, copies): how often each row of ``docs`` is taken.

    Rows of one id are told apart by their text's hash and, where that is equal too, by the times they are
    seen. A null text has size 0; a row of size 0 is taken once and adds no words; null is a source
    of its own, the last; an empty table gives no rows; columns that are not named are ignored.
    """
    read = docs.select(docs[id].alias("_id"), docs[source].alias("_source"), word_count(docs[text]).alias("_size"),
                       F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("_hash"))
    # Rows that agree in all of this are copies of one row: one entry with a count.
    rows = cut_lineage(read.groupBy("_id", "_source", "_size", "_hash").agg(F.count("*").alias("_seen")), "mix-rows")
    goal = targets(rows.withColumn("_all", F.col("_size") * F.col("_seen")), "_source", "_all", weights, share, ceiling)
    goal = cut_lineage(goal, "mix-targets")
    each = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_seen").cast("int"))))
    aimed = each.join(goal, each["_source"].eqNullSafe(goal["source"])).withColumn("_mean", F.try_divide("target", "source_size"))
    aimed = aimed.withColumn("_whole", F.when(F.col("_size") > 0, F.floor("_mean")).otherwise(1).cast("int"))
    key = F.struct(F.col("_id").alias("id"), F.col("_hash").alias("h"), F.col("_n").alias("n"))
    part = F.col("_mean") - F.col("_whole")
    drawn = pivotal_rounding(aimed.where((F.col("_size") > 0) & (part > 0)).select(
        F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("null")).alias("stratum"), key.alias("k"), F.col("_size").alias("s"), part.alias("p")))
    drawn = drawn.select(F.col("k.id").alias("d_id"), F.col("k.h").alias("d_h"), F.col("k.n").alias("d_n"), "extra")
    both = aimed.join(drawn, aimed["_id"].eqNullSafe(drawn["d_id"]) & (aimed["_hash"] == drawn["d_h"]) & (aimed["_n"] == drawn["d_n"]), "left")
    copies = F.col("_whole") + F.coalesce("extra", F.lit(0))
    return both.select(F.col("_id").alias(id), F.col("_hash").alias("text_hash"), F.col("_n").alias("occurrence"), F.col("_size").alias("size"),
                       F.col("_source").alias(source), "source_size", F.col("target").cast("double").alias("target"), copies.cast("int").alias("copies"))


def take(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each repeated as often as ``mix`` takes it, with its columns and no others.

    Rows that agree in id, source and text share their copies in some order, which makes no difference
    unless they differ in a further column."""
    keys = fresh(docs, "_h", "_n", "_copies")
    drawn = mix(docs, text, id, source, **options).select(
        F.col(id).alias("m_id"), F.col(source).alias("m_source"), F.col("text_hash").alias("m_h"), F.col("occurrence").alias("m_n"), "copies")
    # One row for each different document; a second one with all the same is told apart by its number.
    drawn = drawn.groupBy("m_id", "m_source", "m_h").agg(F.transform(F.array_sort(F.collect_list(F.struct("m_n", "copies"))), lambda x: x["copies"]).alias("m_copies"))
    h, n, copies = keys
    marked = docs.withColumn(h, F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    both = marked.join(drawn, marked[id].eqNullSafe(drawn["m_id"]) & marked[source].eqNullSafe(drawn["m_source"]) & (marked[h] == drawn["m_h"]))
    number = F.row_number().over(W.partitionBy("m_id", "m_source", "m_h").orderBy(h))
    return (both.withColumn(n, number).withColumn(copies, F.element_at("m_copies", F.col(n)))
            .withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns))


@query("op8_pivotal_mix")
def op8(spark, sf_dir):
    """All documents mixed to the sources' targets."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
