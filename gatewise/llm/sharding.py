"""Sharding by histogram sort.

Rows are ordered by a 63-bit key: 40 bits of the text's hash, so that equal texts are neighbours, then
23 bits of the row's own hash, so that a group of copies however large can be cut anywhere. The key
boundaries at which the shards end are found by counting the exact bytes below candidate boundaries in
all partitions at once and looking closer only where a boundary still lies, until each is within the
tolerance. Then every row moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.llm.common import fresh, query, table
from gatewise.session import cut_lineage

KEY_BITS = 63
#: Bits by which one round of counting narrows a boundary: so many candidates per open boundary.
ROUND_BITS = 12
CELL_BITS = 12
#: Rows that one task numbers, about; cells with more rows are split.
ROWS_PER_CELL = 250_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def sort_key(text: Column, row: Column) -> Column:
    """Equal texts share the upper bits; ``row`` tells rows of one text apart in the lower ones."""
    group = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 24)
    return F.shiftleft(group, 23).bitwiseOR(F.xxhash64(row).bitwiseAND((1 << 23) - 1))


def splitters(keyed: DataFrame, n_shards: int, tolerance: float = 0.001) -> list[int]:
    """Ascending keys at which shards 1 .. n-1 begin, from columns ``_key`` and ``_size``.

    A boundary is settled once the bytes below it are within ``tolerance`` of a shard's even share, or
    once its candidates are single keys. Per round the driver sees one sum for each candidate:
    at most (n - 1) * 2**12 numbers, whatever the input.
    """
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    goals = {i: total * i / n_shards for i in range(1, n_shards)}
    slack = tolerance * total / n_shards
    found: dict[int, int] = {}
    # prefix of the key -> (bytes below it, boundaries that lie inside it)
    open_at: dict[int, tuple[int, list[int]]] = {0: (0, list(goals))}
    shift = KEY_BITS
    while open_at:
        step = min(ROUND_BITS, shift)
        bucket = F.shiftrightunsigned("_key", shift - step)
        counted = keyed if shift == KEY_BITS else keyed.where(F.shiftrightunsigned("_key", shift).isin(*open_at))
        sums = {r[0]: r[1] for r in counted.groupBy(bucket.alias("b")).agg(F.sum("_size")).collect()}
        nearer: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, inside) in open_at.items():
            left, buckets = sorted(inside), sorted(b for b in sums if b >> step == prefix)
            for b in buckets:
                above = below + sums[b]
                last = b == buckets[-1]
                while left and (goals[left[0]] <= above or last):
                    i, near, near_at = left[0], below, b
                    if abs(above - goals[i]) < abs(below - goals[i]):
                        near, near_at = above, b + 1
                    if abs(near - goals[i]) <= slack or shift == step:
                        found[i] = near_at << (shift - step)
                    else:
                        nearer.setdefault(b, (below, []))[1].append(i)
                    left.pop(0)
                below = above
            for i in left:  # nothing to count
                found[i] = 0
        open_at, shift = nearer, shift - step
    ends = [found[i] for i in range(1, n_shards)]
    return [max(ends[: i + 1]) for i in range(len(ends))]


def shard_of(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or below the key."""
    return F.coalesce(F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= key)), F.lit(0)).cast("int")


def histogram_shards(docs: DataFrame, n_shards: int, tolerance: float = 0.001, text: str = "text", id: str = "doc_id",
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` as ``id``, size, text_crc32, shard, slot and the ``carry`` columns.

    Law ``bytes``: every shard's total size is as near to even as whole rows allow, within ``tolerance``.
    Equal texts stay in one shard unless a boundary falls among them. Slots count from 0 in each shard.
    A null text has size 1 and the checksum of no bytes; a null id is kept; repeated rows are rows of
    their own; an empty table gives no rows; columns that are not named are ignored.
    """
    keyed = docs.select(
        docs[id].alias("_id"), *[docs[c].alias(f"_carry{i}") for i, c in enumerate(carry)], size_of(docs[text]).alias("_size"),
        F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("_crc"),
        sort_key(docs[text], F.struct(docs[id].alias("i"), F.monotonically_increasing_id().alias("n"))).alias("_key"))
    keyed = cut_lineage(keyed, "shard-keys")  # the row number in the key is drawn once
    bounds = splitters(keyed.select("_key", "_size"), n_shards, tolerance)

    cell = F.shiftrightunsigned("_key", KEY_BITS - CELL_BITS)
    placed = keyed.withColumn("_shard", shard_of(F.col("_key"), bounds)).withColumn("_cell", cell)
    # At most 2**12 cells and one more for each boundary: a proven size, small enough to send everywhere.
    counts = placed.groupBy("_shard", "_cell").agg(F.count("*").alias("_n"))
    limit = counts.agg(F.least(F.greatest(F.ceil(F.avg("_n") * 2), F.lit(64)), F.lit(ROWS_PER_CELL)).alias("l")).first()[0] or 1
    parts = counts.select("_shard", "_cell", F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_parts"))
    placed = placed.join(F.broadcast(parts), ["_shard", "_cell"]).withColumn(
        "_part", F.pmod(F.hash("_key"), F.col("_parts"))).drop("_parts")
    group = ["_shard", "_cell", "_part"]
    starts = (placed.groupBy(*group).agg(F.count("*").alias("_n"))
              .withColumn("_base", F.sum("_n").over(W.partitionBy("_shard").orderBy("_cell", "_part")) - F.col("_n")).drop("_n"))
    within = F.row_number().over(W.partitionBy(*group).orderBy("_key", "_id")) - 1
    ranked = placed.withColumn("_rank", within).join(starts, group)
    return ranked.select(F.col("_id").alias(id), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                         F.col("_shard").alias("shard"), (F.col("_base") + F.col("_rank")).cast("long").alias("slot"),
                         *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)])


def write_shards(docs: DataFrame, path: str, n_shards: int, tolerance: float = 0.001, text: str = "text", id: str = "doc_id") -> None:
    """Whole rows of ``docs`` as Parquet below ``path/shard=i``, by the same law; each row moves once.

    A shard is written by many tasks. The row's place in its group of copies comes from its id alone here."""
    key, shard = fresh(docs, "_key", "shard")
    keyed = docs.withColumn(key, sort_key(docs[text], docs[id]))
    bounds = splitters(keyed.select(F.col(key).alias("_key"), size_of(docs[text]).alias("_size")), n_shards, tolerance)
    placed = keyed.withColumn(shard, shard_of(F.col(key), bounds))
    placed.repartitionByRange(shard, key).drop(key).write.partitionBy(shard).parquet(path)


@query("op1_histogram_shards")
def op1(spark, sf_dir):
    """All documents into shards 0 to 7 of nearly equal bytes."""
    out = histogram_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
