"""Frame-to-frame motion: statistics, dominant flow, strip plan and coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.operators.ordered import running, seq_chunk

STILL_ROWS = 0.5


def consecutive_pairs(frames: DataFrame, group: str = "pass_id", seq: str = "seq", chunk_rows: int = 4096) -> DataFrame:
    """Each frame with its predecessor in the pass; the first has none."""
    return running(frames, [group], seq_chunk(F.col(seq), chunk_rows), [seq], prev_seq=("lag", seq))


def motion_stats(motion: DataFrame, group: str = "pass_id") -> DataFrame:
    """Per pass: frames, rows grabbed, frames without motion and total movement.

    The first frame only counts as a frame; its (and any missing) motion adds nothing. Everything
    combines map-side: the first frame's own share is found by ``min_by`` and taken off.
    """
    dx, dy = F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    # A reading exists only as a pair: without dy there is no motion at all.
    dx = F.when(F.col("dy").isNull() | F.col("dx").isNull(), F.lit(0.0)).otherwise(dx)
    still = F.when(F.abs(dy) < STILL_ROWS, 1).otherwise(0)
    agg = motion.groupBy(group).agg(
        F.count("*").alias("n_frames"),
        F.sum("frame_rows").alias("rows_grabbed"),
        F.sum(still).alias("_still"),
        F.sum(F.abs(dx)).alias("_dx"),
        F.sum(F.abs(dy)).alias("_dy"),
        F.min_by(F.struct(still.alias("still"), F.abs(dx).alias("dx"), F.abs(dy).alias("dy")), F.col("seq")).alias("_f"),
    )
    return agg.select(
        group, "n_frames", "rows_grabbed", (F.col("_still") - F.col("_f.still")).alias("n_still"),
        (F.col("_dx") - F.col("_f.dx")).alias("total_abs_dx"), (F.col("_dy") - F.col("_f.dy")).alias("total_abs_dy"))


def coverage_check(motion: DataFrame, rows_per_m: float, fps: float, group: str = "pass_id") -> DataFrame:
    """Gap-free speed ceiling per pass and the number of frames that advance by more than a frame."""
    gap = F.when(F.abs("dy") > F.col("frame_rows"), 1).otherwise(0)
    return motion.groupBy(group).agg(
        (F.max("frame_rows") / F.lit(rows_per_m) * F.lit(fps) * F.lit(3.6)).alias("ceiling_kmh"),
        F.max(F.abs("dy")).alias("max_advance"),
        F.sum(gap).alias("n_gap_frames"))


DIRECTIONS = {"auto": 0, "up": -1, "left": -1, "down": 1, "right": 1}
# Net rows that lock the travel direction, and the most backward motion remembered.
LOCK_ROWS, DEBT_ROWS = 24.0, 48.0


def strip_plan(motion: DataFrame, direction: str = "auto", group: str = "pass_id") -> DataFrame:
    """New image rows each frame contributes and the end they join. ``seq`` numbers a pass's frames.

    A pass holds at most its frame cap, so its motion is one ordered array, folded by column expressions.
    The first frame only serves as reference. ``go`` is the travel direction, 0 until net motion locks
    it; ``due`` are the rows still owed, whole ones of which join the image, half a frame at most at a time. A row
    without ``seq`` has no place in its pass and takes no part; a frame without motion has moved by nothing.
    """
    motion = motion.filter(F.col("seq").isNotNull())
    moved = F.when(F.col("dx").isNotNull() & F.col("dy").isNotNull() & ~F.isnan("dy"), F.col("dy").cast("double")).otherwise(F.lit(0.0))
    frame = F.struct(F.col("seq").cast("long").alias("seq"), F.col("frame_rows").cast("int").alias("frame_rows"), moved.alias("dy"))
    packed = motion.groupBy(group).agg(F.array_sort(F.collect_list(frame)).alias("_f"))
    strips = "array<struct<seq: bigint, rows: int, at_top: boolean>>"
    start = F.struct(F.lit(DIRECTIONS[direction.lower()]).alias("go"), F.lit(0.0).alias("due"), F.array().cast(strips).alias("out"))

    def advance(s: Column, f: Column) -> Column:
        net = s["due"] + f["dy"] * F.when(s["go"] == 0, 1).otherwise(s["go"])
        go = F.when(s["go"] != 0, s["go"]).when(F.abs(net) < LOCK_ROWS, 0).otherwise(F.signum(net).cast("int"))
        due = F.when(s["go"] != 0, F.greatest(net, F.lit(-DEBT_ROWS))).when(go == 0, net).otherwise(F.abs(net))
        whole = F.when((go != 0) & (due >= 1), F.floor(due)).otherwise(0).cast("int")
        strip = F.struct(f["seq"].alias("seq"), F.least(whole, F.floor(f["frame_rows"] / 2).cast("int")).alias("rows"), (go > 0).alias("at_top"))
        return F.struct(go.alias("go"), (due - whole).alias("due"),
                        F.when(whole > 0, F.array_append(s["out"], strip)).otherwise(s["out"]).alias("out"))

    folded = packed.select(group, F.explode(F.aggregate(F.slice("_f", 2, F.greatest(F.size("_f"), F.lit(1))), start, advance)["out"]).alias("s"))
    return folded.select(group, "s.seq", "s.rows", "s.at_top")


def recent_strips(strips: DataFrame, rows: int = 4000, group: str = "pass_id", chunk_rows: int = 4096) -> DataFrame:
    """Newest strips of a pass until their rows reach the limit (the crossing strip included), with
    ``image_order`` increasing down the image: newest first where growth is at the top."""
    back = strips.withColumn("_back", -F.col("seq"))
    cum = running(back, [group], seq_chunk(F.col("_back"), chunk_rows), ["_back"], _cum=("sum", "rows"))
    order = F.when(F.col("at_top"), -F.col("seq")).otherwise(F.col("seq"))
    return cum.filter(F.col("_cum") - F.col("rows") < rows).withColumn("image_order", order).drop("_back", "_cum")


# Fixed values of the flow peak: still threshold, bin width, histogram reach, window half width (absolute and
# relative), least share of pixels, least ratio to the mirrored window, and the scale flow was measured at.
MOVE_PX, BIN_PX, REACH_PX = 0.15, 0.02, 64.0
HALF_PX, HALF_RATIO, MIN_SHARE, MIN_OVER_MIRROR, FLOW_SCALE = 0.25, 0.2, 0.03, 2.0, 0.25
N_BINS = int(2 * REACH_PX / BIN_PX)


#: Frames whose histograms lie in memory at a time: 6,401 numbers each.
FRAMES = 256


def _window_bounds() -> tuple[np.ndarray, np.ndarray]:
    """(low, high) bin of the window around every bin; windows widen with the shift."""
    centre = np.arange(N_BINS)
    shift = np.abs((centre + 0.5) * BIN_PX - REACH_PX)
    half = (np.maximum(HALF_PX, HALF_RATIO * shift) / BIN_PX).astype(np.int64)
    return np.maximum(0, centre - half), np.minimum(N_BINS, centre + half + 1)


def _peaks(frame: np.ndarray, bins: np.ndarray, counts: np.ndarray, n_pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low bin, bin after the last, count) of the best window of each frame, count 0 where nothing clearly moves.

    ``frame`` is the frame's place, for every one of its bins."""
    low, high = _window_bounds()
    cum = np.zeros((len(n_pixels), N_BINS + 1), np.int64)
    cum[frame, bins + 1] = counts
    np.cumsum(cum, axis=1, out=cum)
    window = cum[:, high] - cum[:, low]
    best, each = window.argmax(axis=1), np.arange(len(n_pixels))  # the first maximum: the lowest bin wins ties
    count, mirror = window[each, best], window[each, N_BINS - 1 - best]
    clear = (count > 0) & (count >= MIN_SHARE * n_pixels) & (count >= MIN_OVER_MIRROR * mirror)
    return low[best], high[best], np.where(clear, count, 0)


def flow_peak(flow: DataFrame, group: str = "frame_id") -> DataFrame:
    """Dominant motion per frame in full-resolution pixels; frames without a clear peak give nulls.

    Pixels collapse map-side into at most 6,400 bins per frame with their sums, so a frame is one row with a
    bounded histogram however many pixels it has, and many frames are judged at once. Pixels with a null ``vy`` do
    not move but count; a null ``vx`` adds nothing; pixels with a null frame are one frame; no pixels give no rows.
    """
    moving = F.abs("vy") >= MOVE_PX
    raw_bin = F.floor((F.col("vy") + REACH_PX) / BIN_PX).cast("int")
    bin_ = F.when(moving & raw_bin.between(0, N_BINS - 1), raw_bin).otherwise(F.lit(-1))
    binned = flow.groupBy(group, bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("vx").alias("sx"), F.sum("vy").alias("sy"))
    sums = F.struct("bin", "n", F.coalesce("sx", F.lit(0)).cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"))
    frames = binned.groupBy(group).agg(
        F.sum("n").alias("n_pixels"), F.array_sort(F.collect_list(F.when(F.col("bin") >= 0, sums))).alias("bins"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), FRAMES):
                batch = whole.slice(at, FRAMES)
                lists, pixels = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False)
                frame = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
                bins, n, sx, sy = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                low, high, count = _peaks(frame, bins, n, pixels)
                inside = (bins >= low[frame]) & (bins < high[frame])
                total = [np.bincount(frame[inside], x[inside], len(batch)) / np.maximum(count, 1) / FLOW_SCALE for x in (sx, sy)]
                none = count == 0
                made = [pa.array(count, pa.int64(), mask=none), *(pa.array(x, pa.float64(), mask=none) for x in total)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [group, "n_pixels", "n_peak", "dx", "dy"])

    schema = T.StructType([
        flow.schema[group], T.StructField("n_pixels", T.LongType()), T.StructField("n_peak", T.LongType()),
        T.StructField("dx", T.DoubleType()), T.StructField("dy", T.DoubleType())])
    return frames.mapInArrow(pick, schema)
