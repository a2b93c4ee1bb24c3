"""Sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise import schemas
from gatewise.sources.readers import path_kind, read_scan_events


def _stored(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schemas.SCAN_EVENTS.fields
    ]
    return df.select(*cols, F.to_date("timestamp").alias("event_date"))


def _write_days(df: DataFrame, path: str, mode: str) -> None:
    """Day partitions; adaptive rebalancing gives a busy day as many tasks as its size asks for."""
    (
        df.hint("rebalance", "event_date")
        .write.mode(mode)
        .partitionBy("event_date")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


#: Folder of events without a timestamp.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _on_days(days: list):
    known = F.col("event_date").isin([d for d in days if d is not None])
    return known | F.col("event_date").isNull() if None in days else known


def append_scan_events(events: DataFrame, path: str) -> None:
    """One row per completed pass; passes without a single frame are skipped when ``n_frames`` is known."""
    kept = events.filter("n_frames > 0") if "n_frames" in events.columns else events
    _write_days(_stored(kept), path, "append")


def append_batch_once(spark: SparkSession, path: str):
    """``foreachBatch`` writer that stays idempotent under replay: rows are keyed by lane, timestamp
    and id, nulls included, and only the day partitions the batch touches are read for the check."""

    key = ["lane_name", "timestamp", "id"]

    def write(batch: DataFrame, _epoch: int) -> None:
        rows = _stored(batch).dropDuplicates(key).persist()
        try:
            days = [r[0] for r in rows.select("event_date").distinct().collect()]  # calendar days, not rows
            if not days:
                return
            fresh = rows
            if path_kind(spark, path) != "absent":
                seen = read_scan_events(spark, path).filter(_on_days(days))
                # A struct of nulls equals itself.
                fresh = rows.withColumn("_key", F.struct(*key)).join(seen.select(F.struct(*key).alias("_key")), "_key", "left_anti")
            fresh.select(rows.columns).write.mode("append").partitionBy("event_date").parquet(path)
        finally:
            rows.unpersist()

    return write


def delete_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events without the given ids; unknown ids change nothing."""
    return events.join(ids.select("id").distinct(), "id", "left_anti").select(events.columns)


def delete_scan_events(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Delete stored events by id, rewriting only the day partitions that hold one of them.

    A day emptied by the delete cannot be overwritten dynamically, so its folder is removed.
    """
    stored = read_scan_events(spark, path)
    doomed = stored.join(ids.select("id").distinct(), "id", "left_semi")
    touched = doomed.select("event_date").distinct()
    days = [r[0] for r in touched.collect()]  # calendar days, not rows
    if not days:
        return
    scope = stored.filter(_on_days(days))
    left = delete_events(scope, ids)
    kept_days = {r[0] for r in left.select("event_date").distinct().collect()}
    _write_days(left, path, "overwrite")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    for day in days:
        if day not in kept_days:
            folder = hadoop_path(f"{path}/event_date={day or NO_DAY}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def image_paths(df: DataFrame, root: str, name: str = "lane_name", ts: str = "timestamp",
                content: str | None = "image", suffix: str = "", out: str = "image_path") -> DataFrame:
    """Date-bucketed file name of a stored image; null where there are no bytes."""
    parts = [F.col(name), F.date_format(ts, "yyyyMMdd_HHmmss_SSS")]
    if suffix:
        parts.append(F.lit(suffix))
    file = F.concat(F.lit(root.rstrip("/") + "/"), F.date_format(ts, "yyyy-MM-dd"), F.lit("/"),
                    F.concat_ws("_", *parts), F.lit(".jpg"))
    value = file if content is None else F.when(F.length(content) > 0, file)
    return df.withColumn(out, value)


def write_registry(registry: DataFrame, path: str) -> None:
    """Registry as JSON lines under the names the reader expects."""
    registry.orderBy("id").select(
        F.col("license_plate").alias("LicensePlate"),
        F.col("owner_name").alias("OwnerName"),
        F.col("classification").alias("Classification"),
        F.col("notes").alias("Notes"),
        F.col("id").alias("Id"),
    ).write.mode("overwrite").json(path)


def eval_report_rows(evaluated: DataFrame) -> DataFrame:
    """Report lines: confidence to four decimals, booleans spelled True/False."""
    return evaluated.select(
        "filename",
        "label",
        "text",
        F.format_string("%.4f", F.col("confidence")).alias("confidence"),
        "variant",
        F.when(F.col("correct"), F.lit("True")).otherwise(F.lit("False")).alias("correct"),
    )


def write_eval_report(evaluated: DataFrame, path: str) -> None:
    eval_report_rows(evaluated).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def write_bank(vectors: DataFrame, path: str) -> None:
    """Bank vectors under unique ids. The bank is bounded by ``sample_bank``."""
    vectors.select(F.monotonically_increasing_id().alias("bank_id"), "feat").write.mode("overwrite").parquet(path)
