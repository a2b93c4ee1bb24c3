"""Scan evidence: detections, crops, nearest clean neighbours and anomaly regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.operators import metric
from gatewise.session import cut_lineage

# Least crop that can be read, and the aspect ranges of one- and two-line plates.
MIN_WIDTH, MIN_HEIGHT, MIN_AREA, MIN_SHARPNESS = 48, 16, 900, 18.0
ASPECT_ONE_LINE, ASPECT_TWO_LINE = (1.4, 8.5), (0.6, 1.8)


def crop_metrics(crops: DataFrame) -> DataFrame:
    """Area, aspect, double-line flag and usability from w, h, sharpness."""
    aspect = F.col("w") / F.greatest(F.col("h"), F.lit(1))
    staged = crops.withColumns({"area": F.col("w") * F.col("h"), "aspect": aspect})
    double = F.col("aspect").between(*ASPECT_TWO_LINE)
    usable = (
        (F.col("w") >= MIN_WIDTH) & (F.col("h") >= MIN_HEIGHT) & (F.col("area") >= MIN_AREA)
        & (F.col("aspect").between(*ASPECT_ONE_LINE) | double) & (F.col("sharpness") >= MIN_SHARPNESS)
    )
    return staged.withColumns({"double_line": double, "usable": usable})


def crop_quality(metrics: DataFrame, conf: str = "conf") -> DataFrame:
    """Quality of a crop from detection confidence, area, sharpness and aspect; 0 when unusable."""
    zero, one = F.lit(0.0), F.lit(1.0)
    a = F.col("aspect")
    aspect = F.when(F.col("double_line"), F.greatest(zero, one - F.abs(a - F.lit(1.0)) / F.lit(1.2))).otherwise(
        F.greatest(zero, one - F.abs(a - F.lit(4.5)) / F.lit(4.0)))
    # Weights of confidence, area, sharpness and aspect, and the scales they are taken at.
    quality = (
        F.col(conf) * F.lit(0.45) + F.least(F.col("area") / F.lit(12000.0), one) * F.lit(0.20)
        + F.least(F.col("sharpness") / F.lit(180.0), one) * F.lit(0.25) + aspect * F.lit(0.10)
    )
    return metrics.withColumn("crop_quality", F.when(F.col("usable"), quality).otherwise(zero))


def clip_boxes(boxes: DataFrame, pad_ratio: float, frame_w: int, frame_h: int) -> DataFrame:
    """Pad by a ratio (truncating), clamp to the frame, keep at least one pixel. Replaces x, y, w, h."""
    px = (F.col("w") * F.lit(pad_ratio)).cast("int")
    py = (F.col("h") * F.lit(pad_ratio)).cast("int")
    x1, y1 = F.greatest(F.lit(0), F.col("x") - px), F.greatest(F.lit(0), F.col("y") - py)
    x2 = F.least(F.lit(frame_w), F.col("x") + F.col("w") + px)
    y2 = F.least(F.lit(frame_h), F.col("y") + F.col("h") + py)
    one = F.lit(1)
    return boxes.withColumns({"x": x1, "y": y1, "w": F.greatest(one, x2 - x1), "h": F.greatest(one, y2 - y1)})


def filter_detections(anchors: DataFrame, min_conf: float, classes: list[int] | None = None,
                      scale: float = 1.0, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    """Best class of each anchor's ``scores`` array (the lower class wins ties), thresholds, and boxes
    mapped back from letterboxed model space, rounded half to even. No shuffle: one row per anchor."""
    best = F.array_max(F.transform("scores", lambda s, i: F.struct(s.alias("conf"), (-i).alias("neg"))))
    out = anchors.withColumn("_b", best).withColumns({"conf": F.col("_b.conf"), "class_id": -F.col("_b.neg")})
    out = out.filter((F.col("conf") > 0) & (F.col("conf") >= min_conf))
    if classes is not None:
        out = out.filter(F.col("class_id").isin(*classes))
    k = F.lit(scale)
    x1, x2 = ((F.col("cx") + s * F.col("bw") / 2 - pad_x) / k for s in (-1, 1))
    y1, y2 = ((F.col("cy") + s * F.col("bh") / 2 - pad_y) / k for s in (-1, 1))
    whole = lambda c: F.bround(c, 0).cast("int")
    return out.withColumns({"x": whole(x1), "y": whole(y1), "w": whole(x2 - x1), "h": whole(y2 - y1)}).drop(
        "_b", "scores", "cx", "cy", "bw", "bh")


def frame_visibility(dets: DataFrame, frame_w: int, frame_h: int, group: str = "image_id") -> DataFrame:
    """Best crop quality of a frame's three most confident boxes, less where a box touches the edge."""
    w = W.partitionBy(group).orderBy(F.desc("conf"), "box_id")
    top = dets.withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    scored = crop_quality(crop_metrics(clip_boxes(top, 0.0, frame_w, frame_h)))
    clearance = F.least(F.col("x"), F.col("y"), frame_w - F.col("x") - F.col("w"), frame_h - F.col("y") - F.col("h"))
    # Distance that counts as touching, and what remains then.
    value = F.col("crop_quality") * F.when(clearance <= 2, F.lit(0.65)).otherwise(F.lit(1.0))
    return scored.groupBy(group).agg(F.greatest(F.lit(0.0), F.max(value)).alias("visibility"))


def driver_score(faces: DataFrame, frame_w: int, frame_h: int, group: str = "image_id") -> DataFrame:
    """Best face of a frame by size, sharpness and centredness."""
    f = clip_boxes(faces, 0.0, frame_w, frame_h)
    one = F.lit(1.0)
    dx = F.abs(F.col("x") + F.col("w") / F.lit(2.0) - F.lit(frame_w / 2.0)) / F.lit(frame_w / 2.0)
    dy = F.abs(F.col("y") + F.col("h") / F.lit(2.0) - F.lit(frame_h / 2.0)) / F.lit(frame_h / 2.0)
    # Weights of size, sharpness and centredness, and the scales they are taken at.
    score = (
        F.least(F.col("w") * F.col("h") / F.lit(20000.0), one) * F.lit(0.4)
        + F.least(F.col("sharpness") / F.lit(150.0), one) * F.lit(0.4)
        + F.greatest(F.lit(0.0), one - (dx + dy) / F.lit(2.0)) * F.lit(0.2)
    )
    return f.groupBy(group).agg(F.max(score).alias("driver_score"))


# Suppression ------------------------------------------------------------------------------------

def iou(a: Column, b: Column) -> Column:
    """Overlap of two box structs (x, y, w, h); 0 for empty unions."""
    iw = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    ih = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.when((iw > 0) & (ih > 0), iw * ih).otherwise(F.lit(0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def suppress_boxes(boxes: DataFrame, threshold: float = 0.45, group: str = "image_id",
                   fold_limit: int = 8400) -> DataFrame:
    """Greedy suppression per image by confidence (earlier box first on ties), over all classes.

    Boxes of the very same rectangle shrink to the best one before the shuffle: the others can only
    fall with it. Images of at most ``fold_limit`` boxes (a detector's anchor count) are folded in
    order inside one row; larger ones are settled by rounds over overlapping pairs. Both give the same
    rows for any threshold from 0 to below 1.
    """
    rect = ["x", "y", "w", "h"]
    has_area = F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull(), F.lit(False))
    solid, flat = boxes.filter(has_area), boxes.filter(~has_area)  # what has no area overlaps nothing, so it always stays
    rest = [c for c in boxes.columns if c not in (group, *rect)]
    best = (
        solid.groupBy(group, *rect)
        .agg(F.max_by(F.struct(*rest), F.struct("conf", -F.col("box_id"))).alias("_p"))
        .select(group, *rect, *(F.col(f"_p.{c}").alias(c) for c in rest))
    )
    best = cut_lineage(best, "boxes")  # sized, then routed, without a second pass over the boxes
    large = cut_lineage(best.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > fold_limit).select(group), "crowded")
    if large.isEmpty():
        kept = _suppress_in_rows(best, threshold, group)
    else:
        kept = _suppress_in_rows(best.join(large, group, "left_anti"), threshold, group).unionByName(
            _suppress_by_rounds(best.join(large, group, "left_semi"), threshold, group))
    return kept.select(boxes.columns).unionByName(flat)


def _suppress_in_rows(boxes: DataFrame, threshold: float, group: str) -> DataFrame:
    rest = [c for c in boxes.columns if c != group]
    item = F.struct((-F.col("conf")).alias("_neg"), F.col("box_id").alias("_id"), *rest)
    kind = T.ArrayType(T.StructType([
        T.StructField("_neg", T.DoubleType()), T.StructField("_id", boxes.schema["box_id"].dataType),
        *(boxes.schema[c] for c in rest)]))
    packed = boxes.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("_b"))
    keep = F.aggregate(
        "_b", F.array().cast(kind),
        lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return packed.select(group, F.explode(keep).alias("_k")).select(group, *(F.col(f"_k.{c}") for c in rest))


def _suppress_by_rounds(boxes: DataFrame, threshold: float, group: str) -> DataFrame:
    """Exact greedy result for crowded images. Two boxes over the threshold have alike widths and
    heights and nearby corners, so they meet in a cell of a grid scaled to their own size class;
    a box stays once no earlier overlapping box can stay, and goes once one does."""
    ranked = boxes.withColumn("_rank", F.struct(F.col("conf").alias("c"), (-F.col("box_id")).alias("b")))
    # Size classes double; a partner lies in the same class or a few away. Two boxes share the grid one class
    # above the larger one: its cells are wider than either box, so partners lie in one or in neighbouring cells.
    classes = lambda c: F.floor(F.log2(F.col(c)))
    step = lambda level: F.pow(F.lit(2.0), level)
    placed = ranked.withColumns({"_lw": classes("w"), "_lh": classes("h")})
    # Over the threshold one side is at most 1 / threshold times the other; without one, sizes differ as they may.
    apart = math.ceil(math.log2(1 / threshold)) if threshold > 0 else 31
    span = F.array(*(F.lit(-d) for d in range(min(apart, 31) + 1, 0, -1)))
    # Earlier-or-later partners are found from the smaller class up: both sides probe the grid above the
    # larger class, one side over the neighbouring cells.
    levels = placed.withColumn("_gw", F.explode(F.transform(span, lambda d: F.col("_lw") - d))).withColumn(
        "_gh", F.explode(F.transform(span, lambda d: F.col("_lh") - d)))
    cells = levels.withColumns({
        "_cx": F.floor(F.col("x") / step(F.col("_gw"))), "_cy": F.floor(F.col("y") / step(F.col("_gh")))})
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probe = cells.withColumn("_cx", F.explode(F.transform(near, lambda d: F.col("_cx") + d))).withColumn(
        "_cy", F.explode(F.transform(near, lambda d: F.col("_cy") + d)))
    box = lambda: F.struct("x", "y", "w", "h")
    key = [group, "_gw", "_gh", "_cx", "_cy"]
    a = probe.select(*key, F.col("box_id").alias("early"), F.col("_rank").alias("ra"), box().alias("ba"))
    b = cells.select(*key, F.col("box_id").alias("late"), F.col("_rank").alias("rb"), box().alias("bb"))
    edges = cut_lineage(
        a.join(b, key).filter((F.col("ra") > F.col("rb")) & (iou(F.col("ba"), F.col("bb")) > threshold))
        .select(group, "early", "late").distinct())
    open_ids = cut_lineage(boxes.select(group, "box_id"))
    kept = open_ids.limit(0)
    while not open_ids.isEmpty():
        live = edges.join(open_ids.withColumnRenamed("box_id", "early"), [group, "early"], "left_semi").join(
            open_ids.withColumnRenamed("box_id", "late"), [group, "late"], "left_semi")
        free = open_ids.join(live.select(group, F.col("late").alias("box_id")), [group, "box_id"], "left_anti")
        free = cut_lineage(free)
        gone = edges.join(free.withColumnRenamed("box_id", "early"), [group, "early"], "left_semi").select(
            group, F.col("late").alias("box_id"))
        kept = kept.unionByName(free)
        open_ids = cut_lineage(open_ids.join(free.unionByName(gone), [group, "box_id"], "left_anti"))
    return boxes.join(kept, [group, "box_id"], "left_semi")


# Anomaly scoring --------------------------------------------------------------------------------

BANK_VECTORS = 4000


def sample_bank(patches: DataFrame, n: int | None = BANK_VECTORS, seed: int = 42, keys: tuple[str, ...] = ("image_id", "cell")) -> DataFrame:
    """All patches when there are at most ``n`` (or ``n`` is None), else a uniform sample of ``n`` fixed by the seed.

    The order is a hash of the patch's own keys, so it does not depend on partitioning. Only keys and
    hashes take part in the top-n; the vectors of the chosen few are fetched by a semi-join.
    """
    if n is None:
        return patches
    ids = patches.select(*keys, F.xxhash64(F.lit(seed), *keys).alias("_h"))
    chosen = ids.orderBy("_h", *keys).limit(n).select(*keys)
    return patches.join(F.broadcast(chosen), list(keys), "left_semi")  # at most n key rows


def nearest_bank_distance(patches: DataFrame, bank: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """Adds ``distance``: least Euclidean distance of a patch to any bank vector.

    A bank of at most ``block_bytes``, such as a sampled one (``sample_bank``), is broadcast, and patches stream through
    matrix products without a shuffle. A larger one is partitioned (``metric.partitioned_distance``). Vectors that are null,
    empty or hold null or non-finite components take no part: such a patch has no distance, such a bank row
    is no neighbour. A bank without a usable vector is an error.
    """
    spark = patches.sparkSession
    known = bank.select(F.col("feat").cast("array<double>").alias("feat")).filter(metric.usable(F.col("feat")))
    shape = known.agg(F.count("*").alias("n"), F.max(F.size("feat")).alias("dim")).first()
    if not shape["n"]:
        raise ValueError("bank is empty")
    if shape["n"] * shape["dim"] * 8 > block_bytes:
        return metric.partitioned_distance(patches, known)
    shared = spark.sparkContext.broadcast(np.array(known.toArrow()["feat"].to_pylist()))  # at most block_bytes

    def nearest(feat: pa.Array, ok: pa.Array) -> pa.Array:
        out, at = np.full(len(feat), np.nan), np.flatnonzero(ok.to_numpy(zero_copy_only=False))
        if len(at):
            out[at] = metric.nearest_rows(metric.stacked(feat.take(pa.array(at)), shared.value.shape[1]), shared.value)
        return pa.array(out, mask=np.isin(np.arange(len(feat)), at, invert=True))

    nearest.__annotations__ = {"feat": pa.Array, "ok": pa.Array, "return": pa.Array}
    feat = F.col("feat").cast("array<double>")
    return patches.withColumn("distance", F.arrow_udf(nearest, "double")(feat, metric.usable(feat)))


def image_anomaly(patch_dist: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Largest patch distance per image and whether it passes the threshold."""
    return patch_dist.groupBy("image_id").agg(F.max("distance").alias("score")).withColumn(
        "flagged", F.col("score") > threshold)


def calibrate_threshold(patch_dist: DataFrame, labels: DataFrame) -> DataFrame:
    """Range of image scores per label, for choosing a threshold between clean and dirty."""
    scores = patch_dist.groupBy("image_id").agg(F.max("distance").alias("score"))
    return scores.join(labels, "image_id").groupBy("label").agg(
        F.count("*").alias("n_images"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"))


def find_regions(cells: list[tuple[int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Outermost 8-connected groups of flagged (gy, gx, dist) cells as (x, y, w, h, max distance in the
    rectangle). A group enclosed in another group's hole is not reported."""
    flagged = {(y, x): d for y, x, d in cells}
    if not flagged:
        return []
    top, left = min(y for y, _ in flagged) - 1, min(x for _, x in flagged) - 1
    low, right = max(y for y, _ in flagged) + 1, max(x for _, x in flagged) + 1
    outside, todo = {(top, left)}, [(top, left)]
    while todo:
        y, x = todo.pop()
        for c in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if top <= c[0] <= low and left <= c[1] <= right and c not in flagged and c not in outside:
                outside.add(c)
                todo.append(c)
    found, seen = [], set()
    for start in sorted(flagged):
        if start in seen:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            group.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    c = (y + dy, x + dx)
                    if c in flagged and c not in seen:
                        seen.add(c)
                        todo.append(c)
        if not any(c in outside for y, x in group for c in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))):
            continue
        y1, x1 = min(y for y, _ in group), min(x for _, x in group)
        y2, x2 = max(y for y, _ in group), max(x for _, x in group)
        if (y2 - y1 + 1) * (x2 - x1 + 1) < 2:
            continue
        peak = max(d for (y, x), d in flagged.items() if y1 <= y <= y2 and x1 <= x <= x2)
        found.append((x1, y1, x2 - x1 + 1, y2 - y1 + 1, peak))
    return found


def anomaly_regions(patch_dist: DataFrame, threshold: float, grid_w: int, grid_h: int, image_w: int, image_h: int) -> DataFrame:
    """Regions of connected flagged cells in image pixels with their largest distance.

    Only flagged cells travel, one row per cell after a combining aggregate, so an image sends at
    most its grid (``grid_w`` x ``grid_h``) to the region step. A flagged cell outside the grid is an error.
    """
    inside = F.col("gx").between(0, grid_w - 1) & F.col("gy").between(0, grid_h - 1)
    lost = F.raise_error(F.concat_ws(" ", F.lit("cell outside the grid:"), "image_id", "gy", "gx"))
    cells = (
        patch_dist.filter(F.when(F.col("distance") > threshold, F.when(inside, True).otherwise(lost.cast("boolean"))))
        .groupBy("image_id", "gy", "gx").agg(F.max("distance").alias("distance"))
        .groupBy("image_id").agg(F.collect_list(F.struct("gy", "gx", "distance")).alias("cells"))
    )

    @F.pandas_udf("array<struct<x:int,y:int,w:int,h:int,d:double>>")
    def regions(col: pd.Series) -> pd.Series:
        return pd.Series([
            [dict(zip("xywhd", r)) for r in find_regions([(c["gy"], c["gx"], c["distance"]) for c in cs])] for cs in col
        ], dtype=object)

    sx, sy = F.lit(image_w / grid_w), F.lit(image_h / grid_h)
    r = cells.select("image_id", F.explode(regions("cells")).alias("r"))
    return r.select(
        "image_id", (F.col("r.x") * sx).cast("int").alias("x"), (F.col("r.y") * sy).cast("int").alias("y"),
        F.greatest(F.lit(1), (F.col("r.w") * sx).cast("int")).alias("w"),
        F.greatest(F.lit(1), (F.col("r.h") * sy).cast("int")).alias("h"), F.col("r.d").alias("max_distance"))
