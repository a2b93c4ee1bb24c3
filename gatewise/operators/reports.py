"""History search, KPIs, hourly traffic and read-accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.schemas import ADMISSION_NAMES, APPROVED, DENIED


def admission_name(c: Column) -> Column:
    named = F.when(c == 0, F.lit(ADMISSION_NAMES[0]))
    for code in (1, 2):
        named = named.when(c == code, F.lit(ADMISSION_NAMES[code]))
    return named


def recent_events(events: DataFrame, n: int | None = 500) -> DataFrame:
    """Newest ``n`` events by id (all of them for ``None``)."""
    return events if n is None else events.orderBy(F.desc("id")).limit(n)


def history_search(
    events: DataFrame,
    plate: str = "",
    admission: str = "",
    start: str | None = None,
    end: str | None = None,
    limit: int | None = 500,
) -> DataFrame:
    """Filter the newest ``limit`` events; ``limit=None`` searches the whole table with pushdown."""
    out = recent_events(events, limit)
    if plate.strip():
        out = out.filter(F.lower("plate_text").contains(plate.lower()))
    if admission:
        out = out.filter(admission_name(F.col("admission")) == admission)
    # Half-open timestamp bounds equal the inclusive calendar-date bounds and still push down.
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
        out = out.filter(F.col("timestamp") < after)
    return out


def history_rows(events: DataFrame) -> DataFrame:
    """Display projection of the history page."""
    return events.select(
        "id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("inspected_at"),
        F.when(F.length("plate_text") > 0, F.col("plate_text")).otherwise(F.lit("-")).alias("plate"),
        F.when(F.col("foreign_object_detected"), F.lit("Threat")).otherwise(F.lit("Clean")).alias("threat_scan"),
        admission_name(F.col("admission")).alias("admission"),
    )


def pass_detail(events: DataFrame, event_id: int, limit: int | None = 500) -> DataFrame:
    """One pass among the newest ``limit``, with the state of its plate text."""
    one = recent_events(events, limit).filter(F.col("id") == event_id)
    confirmed = F.when(F.col("plate_text_valid"), F.lit("CONFIRMED")).otherwise(F.lit("UNCONFIRMED"))
    return one.withColumn("plate_status", confirmed)


def lane_log(events: DataFrame, n: int = 15, per_lane: bool = False) -> DataFrame:
    """Newest ``n`` events overall, or per lane. The per-lane rank prunes before the shuffle."""
    if not per_lane:
        return recent_events(events, n)
    w = W.partitionBy("lane_name").orderBy(F.desc("id"))
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def kpi_totals(events: DataFrame, limit: int | None = 500, by: str | None = None) -> DataFrame:
    scope = recent_events(events, limit)
    grouped = scope.groupBy(by) if by else scope.groupBy()
    return grouped.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("admission") == APPROVED).alias("approved"),
        F.count_if(F.col("admission") == DENIED).alias("denied"),
        F.count_if(F.col("foreign_object_detected")).alias("threats"),
    )


def safety_split(events: DataFrame, limit: int | None = 500) -> DataFrame:
    """Cleared and flagged counts with their shares of the total (0 when there is nothing)."""
    total = F.col("total")
    threats = F.col("threats")
    share = lambda part: F.when(total == 0, F.lit(0.0)).otherwise(part / total)
    return kpi_totals(events, limit).select(
        "total",
        (total - threats).alias("cleared"),
        "threats",
        share(total - threats).alias("cleared_share"),
        share(threats).alias("threat_share"),
    )


def hourly_distribution(events: DataFrame, limit: int | None = 500) -> DataFrame:
    """Events per hour of local time, all 24 hours present."""
    counts = recent_events(events, limit).groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n_events"))


def join_eval(labels: DataFrame, reads: DataFrame) -> DataFrame:
    """Exact match of label and text per file."""
    return labels.join(reads, "filename").withColumn("correct", F.col("label") == F.col("text"))


def labels_with_image(labels: DataFrame, images: DataFrame) -> DataFrame:
    return labels.join(images.select("filename"), "filename", "left_semi")


def diff_reports(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files on which two evaluation runs disagree in any field, or that only one has."""
    names = [c for c in left.columns if c != "filename"]
    a = left.select("filename", *(F.col(c).alias(f"{c}_left") for c in names), F.lit(True).alias("in_left"))
    b = right.select("filename", *(F.col(c).alias(f"{c}_right") for c in names), F.lit(True).alias("in_right"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right"))
    both = a.join(b, "filename", "full_outer")
    return both.filter(~(same & F.col("in_left").isNotNull() & F.col("in_right").isNotNull())).drop(
        "in_left", "in_right"
    )


def accuracy(evaluated: DataFrame) -> DataFrame:
    """Correct, total and percent overall and by source prefix of the file name."""
    source = (
        F.when(F.col("filename").startswith("new_"), F.lit("new"))
        .when(F.col("filename").startswith("old_"), F.lit("old"))
        .otherwise(F.lit("other"))
    )
    return (
        evaluated.select(source.alias("source"), "correct")
        .rollup("source")
        .agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("n_total"), F.grouping("source").alias("g"))
        .select(
            F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("source")).alias("source"),
            "n_correct",
            "n_total",
            (F.lit(100.0) * F.col("n_correct") / F.col("n_total")).alias("percent"),
        )
    )


def mismatches(evaluated: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` wrong reads in input order."""
    return evaluated.filter(~F.col("correct")).orderBy("line_no").limit(n)
