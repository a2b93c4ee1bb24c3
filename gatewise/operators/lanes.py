"""Lane configuration: joins over controller and camera tables, edits, status lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.functions.plates import parse_positions
from gatewise.operators.registry import number_rows

CAMERA_KINDS = ("driver", "anpr", "underbody")


def enabled_lanes(lanes: DataFrame) -> DataFrame:
    return lanes.filter("enabled")


def lane_list(table: DataFrame) -> DataFrame:
    return table.orderBy("id")


def lane_positions(controllers: DataFrame, strict: bool = False) -> DataFrame:
    """Loop positions per lane; fewer than two make the lane unusable (an error when ``strict``)."""
    parsed = controllers.withColumn("positions", parse_positions(F.col("loop_positions")))
    usable = F.size("positions") >= 2
    if strict:
        return parsed.withColumn(
            "positions",
            F.when(usable, F.col("positions")).otherwise(
                F.raise_error(F.concat(F.lit("lane needs at least 2 loop positions: "), F.col("lane_id")))
            ),
        )
    return parsed.withColumn("usable", usable)


def _unique_by_lane(camera: DataFrame, kind: str) -> DataFrame:
    """One camera per lane; a repeated lane id is a configuration error."""
    keep = [c for c in camera.columns if c not in ("lane_id", "kind")]
    message = F.concat(F.lit(f"duplicate {kind} camera for lane "), F.col("lane_id"))
    return (
        camera.groupBy("lane_id")
        .agg(F.count("*").alias("n"), F.first(F.struct(*keep)).alias("cam"))
        .withColumn("cam", F.when(F.col("n") > 1, F.raise_error(message)).otherwise(F.col("cam")))
        .select("lane_id", *(F.col(f"cam.{c}").alias(f"{kind}_{c}") for c in keep))
    )


def lane_config(controllers: DataFrame, driver: DataFrame, anpr: DataFrame, underbody: DataFrame) -> DataFrame:
    """One row per controller with each camera table joined on the lane id."""
    out = controllers
    for kind, camera in zip(CAMERA_KINDS, (driver, anpr, underbody)):
        out = out.join(_unique_by_lane(camera, kind), "lane_id", "left")
    return out


def device_inventory(
    controllers: DataFrame, driver: DataFrame, anpr: DataFrame, underbody: DataFrame, status: DataFrame | None = None
) -> DataFrame:
    """One list over all devices; ``status`` (lane_id, kind, online) adds the badge, offline where absent."""
    parts = [controllers.select("id", "lane_id", F.lit("controller").alias("kind"), F.col("gate_name").alias("name"))]
    for kind, camera in zip(CAMERA_KINDS, (driver, anpr, underbody)):
        parts.append(camera.select("id", "lane_id", F.lit(kind).alias("kind"), F.col("camera_name").alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if status is None:
        return out
    return out.join(status.select("lane_id", "kind", "online"), ["lane_id", "kind"], "left").withColumn(
        "online", F.coalesce("online", F.lit(False))
    )


# The fields each kind of edit must carry.
REQUIRED_FIELDS = {
    "controller": ("lane_id", "ip", "gate_name"),
    "driver": ("lane_id", "ip", "camera_name"),
    "anpr": ("lane_id", "ip", "camera_name"),
    "underbody": ("lane_id", "device_serial", "camera_name"),
}


def upsert_lane_table(current: DataFrame, changes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Apply edits: a null id inserts after the highest id, a known id updates the edited fields.

    Returns the new table and the refused edits with the reason. ``changes`` has a ``seq`` column
    giving the order of edits; the last edit of an id wins.
    """
    fields = REQUIRED_FIELDS[kind]
    reason = F.lit(None).cast("string")
    for f in reversed(fields):
        blank = ~F.coalesce(F.col(f), F.lit("")).rlike("\\S")
        reason = F.when(blank, F.lit(f"{f} is required")).otherwise(reason)
    ids = current.select(F.col("id").alias("known_id"))
    checked = (
        changes.join(ids, F.col("id") == F.col("known_id"), "left")
        .withColumn("reason", reason)
        .withColumn(
            "reason",
            F.coalesce(
                "reason",
                F.when(F.col("id").isNotNull() & F.col("known_id").isNull(), F.lit("row no longer exists")),
            ),
        )
        .drop("known_id")
    )
    rejected = checked.filter("reason IS NOT NULL")
    good = checked.filter("reason IS NULL")
    updates = good.filter("id IS NOT NULL").groupBy("id").agg(
        F.max_by(F.struct(*fields), F.col("seq")).alias("new")
    )
    updated = current.join(updates, "id", "left").select(
        *(
            F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in current.columns
        )
    )
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]  # one number
    id_type = current.schema["id"].dataType
    inserted = number_rows(good.filter("id IS NULL"), "seq").withColumn(
        "id", (F.lit(top).cast("long") + F.col("rank")).cast(id_type))
    for c in current.columns:
        if c not in inserted.columns:
            inserted = inserted.withColumn(c, F.lit(None).cast(current.schema[c].dataType))
    return updated.unionByName(inserted.select(current.columns)), rejected
