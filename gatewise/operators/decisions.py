"""Admission decision, pass metrics and pass outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.schemas import APPROVED, BLACKLIST, DENIED, NORMAL, PENDING, WHITELIST


def decide_admission(matched: DataFrame, foreign: str = "foreign_object_detected") -> DataFrame:
    """Ordered rule: a foreign object denies, then blacklist denies, whitelist approves, the rest waits.

    Expects the columns of ``match_registry``; adds driver_name, admission, dossier_notes.
    """
    flagged = F.coalesce(F.col(foreign), F.lit(False))
    cls = F.coalesce(F.col("classification"), F.lit(NORMAL))
    note = F.coalesce(F.col("registry_notes"), F.lit(""))
    found = F.col("registry_id").isNotNull()

    def told(text: str) -> Column:
        return F.trim(F.concat(F.lit(text + " "), note))

    admission = (
        F.when(flagged | (cls == BLACKLIST), F.lit(DENIED))
        .when(cls == WHITELIST, F.lit(APPROVED))
        .otherwise(F.lit(PENDING))
    )
    # Dossier wording.
    dossier = (
        F.when(flagged & (cls == BLACKLIST), told("CRITICAL ALERT: Blacklisted vehicle with a flagged scan region!"))
        .when(flagged, told("THREAT DETECTED: foreign-object scan flagged this pass -- manual inspection required."))
        .when(cls == BLACKLIST, told("CRITICAL ALERT: Blacklisted vehicle!"))
        .when(cls == WHITELIST, told("Auto-Approved: Registered vehicle."))
        .when(found, told("Scan complete. No anomalies detected."))
        .otherwise(F.lit("Scan complete. No anomalies detected. Vehicle not in registry."))
    )
    owner = F.when(F.length("owner_name") > 0, F.col("owner_name")).otherwise(F.lit("Unknown"))
    return matched.withColumns({"driver_name": owner, "admission": admission, "dossier_notes": dossier})


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with microsecond precision between two timestamps (zoned or not)."""
    return (_micros(end) - _micros(start)) / F.lit(1e6)


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def pass_metrics(passes: DataFrame, lanes: DataFrame) -> DataFrame:
    """Average speed from loop spacing and engage times; duration up to exit clear.

    ``passes`` carries entry_ts, exit_engage_ts, exit_clear_ts; ``lanes`` lane_id and the
    array ``positions``. Lanes are configuration: one row per controller.
    """
    spacing = lanes.select(
        F.col("lane_id").alias("lane"),
        (F.try_element_at("positions", F.lit(-1)) - F.try_element_at("positions", F.lit(1))).alias("spacing_m"),
    )
    travel = seconds_between(F.col("entry_ts"), F.col("exit_engage_ts"))
    tail = F.coalesce("exit_clear_ts", "exit_engage_ts", "entry_ts")
    return passes.join(spacing, "lane", "left").withColumns(
        {
            "speed_mps": F.when(travel > 0, F.col("spacing_m") / travel).otherwise(F.lit(0.0)),
            "duration_s": seconds_between(F.col("entry_ts"), tail),
        }
    )


# Outcome names.
COMPLETED, NEVER_ENGAGED, NEVER_CLEARED, FRAME_CAP = (
    "completed", "exit_never_engaged", "exit_never_cleared", "frame_cap",
)


def classify_fault(passes: DataFrame, fold_frame_cap: bool = False) -> DataFrame:
    """Outcome of each pass. A pass cut short by the frame cap is its own class unless
    ``fold_frame_cap`` reports it with the time-limit classes by number of loop times, which are
    ``n_loop_times`` where the passes have them."""
    loops = F.when(F.col("exit_engage_ts").isNotNull(), 2).otherwise(1)
    if "n_loop_times" in passes.columns:
        loops = F.coalesce("n_loop_times", loops)
    timed_out = F.when(loops > 1, F.lit(NEVER_CLEARED)).otherwise(F.lit(NEVER_ENGAGED))
    capped = F.coalesce(F.col("frame_cap_hit"), F.lit(False))
    if fold_frame_cap:
        outcome = F.when(F.col("exit_clear_ts").isNotNull() & ~capped, F.lit(COMPLETED)).otherwise(timed_out)
    else:
        outcome = (
            F.when(capped, F.lit(FRAME_CAP))
            .when(F.col("exit_clear_ts").isNotNull(), F.lit(COMPLETED))
            .otherwise(timed_out)
        )
    return passes.withColumn("outcome", outcome)


def pass_outcomes(classified: DataFrame) -> DataFrame:
    """Passes per lane and outcome (completed and every fault class)."""
    return classified.groupBy("lane", "outcome").agg(F.count("*").alias("n_passes"))
