"""Vehicle registry: lookup, search and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.functions.plates import lookup_key, registry_key
from gatewise.session import cut_lineage


def registry_by_key(registry: DataFrame) -> DataFrame:
    """One row per normalized plate: the entry stored first (lowest id) wins. Combines map-side."""
    entry = F.struct("id", "owner_name", "classification", "notes")
    return (
        registry.groupBy(registry_key(F.col("license_plate")).alias("reg_key"))
        .agg(F.min_by(entry, F.col("id")).alias("entry"))
        .select(
            "reg_key",
            F.col("entry.id").alias("registry_id"),
            F.col("entry.owner_name").alias("owner_name"),
            F.col("entry.classification").alias("classification"),
            F.col("entry.notes").alias("registry_notes"),
        )
    )


def _spread_blank(plate: Column, columns: list[str]) -> Column:
    """Join key of a read. Blank reads match nothing, so they get scattered keys no registry
    key can equal; a large share of blank plates then cannot pile up in one shuffle partition."""
    scatter = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*columns), F.lit(4096)).cast("string"))
    return F.coalesce(lookup_key(plate), scatter)


def match_registry(passes: DataFrame, registry: DataFrame, plate: str = "plate_text") -> DataFrame:
    """Left join to the registry on normalized plate. No broadcast hint: Spark broadcasts the
    registry while its size estimate stays below the threshold and shuffles it beyond that."""
    keyed = passes.withColumn("reg_key", _spread_blank(F.col(plate), passes.columns))
    return keyed.join(registry_by_key(registry), "reg_key", "left").drop("reg_key")


def unregistered_passes(passes: DataFrame, registry: DataFrame, plate: str = "plate_text") -> DataFrame:
    keyed = passes.withColumn("reg_key", _spread_blank(F.col(plate), passes.columns))
    keys = registry.select(registry_key(F.col("license_plate")).alias("reg_key"))
    return keyed.join(keys, "reg_key", "left_anti").drop("reg_key")


def registry_search(registry: DataFrame, text: str = "", classification: int | None = None) -> DataFrame:
    """Case-insensitive plate substring plus classification, newest first."""
    out = registry
    if text.strip():
        out = out.filter(F.lower("license_plate").contains(text.lower()))
    if classification is not None:
        out = out.filter(F.col("classification") == classification)
    return registry_list(out)


def registry_list(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("id"))


def registry_add(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Append entries with ids after the present maximum, in the order of ``rows.seq``.

    Blank plates are refused; repeated plates are allowed. ``rows`` is an operator's edit batch.
    """
    fields = ["license_plate", "owner_name", "notes"]
    clean = rows.filter(F.col("license_plate").rlike("\\S")).withColumns(
        {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in fields}
    )
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]  # one number
    numbered = number_rows(clean, "seq").withColumn("id", F.lit(top).cast("long") + F.col("rank")).drop("rank", "seq")
    return registry.unionByName(numbered.select(registry.columns))


def number_rows(df: DataFrame, seq: str) -> DataFrame:
    """Dense 1-based rank by ``seq`` without a single global window: rank inside ranges of rows as
    Spark cuts them, shifted by the row counts of earlier ranges (one row per range, however sparse ids are)."""
    blocked = cut_lineage(df.repartitionByRange(seq).withColumn("_block", F.spark_partition_id()), "ranges")
    inner = W.partitionBy("_block").orderBy(seq)
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("_block").count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    return (
        blocked.withColumn("_in", F.row_number().over(inner))
        .join(starts, "_block")
        .withColumn("rank", (F.col("_in") + F.col("_before")).cast("long"))
        .drop("_block", "_in", "_before")
    )


def registry_remove(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("id").distinct(), "id", "left_anti").select(registry.columns)
