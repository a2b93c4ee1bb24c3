"""Streaming forms of the sensor, motion and reporting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.functions import machines as M
from gatewise.operators import motion, reports, sensors
from gatewise.operators.ordered import from_micros, micros
from gatewise.streaming.processors import DebounceTimers, LevelFold, OrderedFold

_END = "_end_of_input"


def clocked(rows: DataFrame, delay: str, ends: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """``rows`` under a watermark. ``ends`` (ts) are closing times: they move the watermark and go no further.

    Rows with a column ``clock`` (``streaming.late``) are timed by it instead, and keep their own time.
    """
    clock = "clock" if "clock" in rows.columns else ts
    timed = rows.withColumns({c: F.col(c).cast("timestamp") for c in {ts, clock}})
    if ends is None:
        return timed.withWatermark(clock, delay)
    last = ends.select(F.col("ts").cast("timestamp").alias(clock), F.lit(True).alias(_END))
    both = timed.withColumn(_END, F.lit(False)).unionByName(last, allowMissingColumns=True).withWatermark(clock, delay)
    # The condition names the clock, so the optimizer leaves it above the watermark.
    return both.filter(~F.col(_END) | F.col(clock).isNull()).drop(_END)


def _timeline(states: DataFrame, delay: str, ends: DataFrame | None, frames: DataFrame | None = None) -> DataFrame:
    """Lane events with their time in microseconds, under the watermark."""
    keep = ("clock",) if "clock" in states.columns else ()
    return clocked(sensors.lane_events(states, frames, keep).withColumn("us", micros(F.col("ts"))), delay, ends)


def detect_passes_stream(states: DataFrame, debounce_s: float = 0.05, max_s: float = 30.0, max_frames: int = 2000,
                         n_loops: int = 2, delay: str = "10 seconds", frames: DataFrame | None = None,
                         lanes: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Passes as they end. ``states``: lane, ts, seq, kind, loops; reordering within ``delay`` is undone.

    ``frames`` (lane, ts, frame_id) count towards the frame cap; ``lanes`` as in the batch form, a row for
    each controller.
    """
    config = sensors.machine_config(n_loops, debounce_s, max_s, max_frames)
    own = {}
    if lanes is not None:
        own = {r["lane"]: {k: v for k, v in r.asDict().items() if k != "lane" and v is not None} for r in sensors.lane_settings(lanes).collect()}
    events = _timeline(states, delay, ends, frames)
    schema = T.StructType([states.schema["lane"], *sensors._PASS.elementType.fields])
    fold = OrderedFold("lane", M.advance_lane, config, ("kind", "loops"), schema.names, clock=True, own=own)
    folded = events.groupBy("lane").transformWithStateInPandas(fold, schema, "Append", "EventTime")
    return sensors.pass_columns(folded)


def loop_state_stream(messages: DataFrame, n_loops: int = 2, delay: str = "10 seconds", ends: DataFrame | None = None) -> DataFrame:
    """Known loop vector (as text) after each message, in event order per lane."""
    def level(i):
        told = F.get("loops", F.lit(i)).cast("long")
        return F.when(F.col("kind") == M.DISCONNECT, F.lit(0)).otherwise(F.coalesce(told, F.lit(-1))).cast("long")

    events = _timeline(messages, delay, ends).withColumns({f"level{i}": level(i) for i in range(n_loops)}).drop("kind", "loops")
    schema = T.StructType([messages.schema["lane"], T.StructField("seq", T.LongType()), T.StructField("vector", T.StringType())])
    return events.groupBy("lane").transformWithStateInPandas(LevelFold("lane", n_loops), schema, "Append", "EventTime")


def debounced_entries_stream(states: DataFrame, debounce_s: float = 0.05, delay: str = "10 seconds", ends: DataFrame | None = None) -> DataFrame:
    """Entries as their debounce ends: (lane, engaged_ts, entry_ts). ``states``: lane, ts, seq, loops; without a level of
    loop 0 a row counts as released. An entry is told when the watermark reaches it, also if no further row comes.
    """
    keep = ("clock",) if "clock" in states.columns else ()
    level = states.select("lane", "ts", "seq", F.get("loops", F.lit(0)).alias("on"), micros(F.col("ts")).alias("us"), *keep)
    schema = T.StructType([states.schema["lane"], T.StructField("engaged", T.LongType())])
    timers = DebounceTimers("lane", round(debounce_s * 1e6))
    found = clocked(level, delay, ends).groupBy("lane").transformWithStateInPandas(timers, schema, "Append", "EventTime")
    engaged = from_micros(F.col("engaged"))
    return found.select("lane", engaged.alias("engaged_ts"), (engaged + sensors.interval(debounce_s)).alias("entry_ts"))


def strip_plan_stream(frames: DataFrame, direction: str = "auto", delay: str = "10 seconds", idle_s: float = 3600.0,
                      ends: DataFrame | None = None) -> DataFrame:
    """Strips as frames arrive. ``frames``: pass_id, seq, ts, frame_rows, dx, dy. A pass silent for
    ``idle_s`` has ended, and its state goes."""
    events = clocked(frames.withColumn("us", micros(F.col("ts"))).withColumn("dy", F.when(F.col("dx").isNotNull(), F.col("dy"))), delay, ends)
    schema = T.StructType([
        frames.schema["pass_id"], T.StructField("seq", T.LongType()), T.StructField("rows", T.IntegerType()), T.StructField("at_top", T.BooleanType())])
    fold = OrderedFold("pass_id", M.fold_strips, {"direction": motion.DIRECTIONS[direction]},
                       ("frame_rows", "dy"), schema.names, clock=False, idle_s=idle_s)
    return events.groupBy("pass_id").transformWithStateInPandas(fold, schema, "Append", "EventTime")


def liveness_stream(beats: DataFrame, keys: list[str], timeout_s: float, delay: str = "10 seconds", ends: DataFrame | None = None) -> DataFrame:
    """Closed online intervals: a device's beats form a session that ends a timeout after the last one."""
    timed = clocked(beats, delay, ends)
    # Sessions that touch are merged, so they end a microsecond short of the timeout.
    session = F.session_window("ts", f"{int(timeout_s * 1_000_000) - 1} microseconds")
    return timed.groupBy(*keys, session).agg(F.count("*").alias("n_beats")).select(
        *keys, F.col("session_window.start").cast("timestamp_ntz").alias("online_from"),
        (F.col("session_window.end").cast("timestamp_ntz") + F.expr("INTERVAL 0.000001 SECOND")).alias("online_until"), "n_beats")


def pass_frames_stream(passes: DataFrame, frames: DataFrame, max_s: float = 30.0, delay: str = "10 seconds") -> DataFrame:
    """Frames of each pass, joined as both streams arrive.

    The join key is (lane, time bucket) as in the batch form, so a busy lane spreads over partitions
    and a frame is only compared with passes near it in time; the interval bounds let Spark drop state.
    """
    bucket = lambda c: F.floor(micros(c) / F.lit(int(max_s * 1_000_000)))
    p = passes.withColumns({
        "end_ts": sensors.capture_end(max_s).cast("timestamp"), "entry_ts": F.col("entry_ts").cast("timestamp"),
    }).withColumnRenamed("lane", "pass_lane").withWatermark("entry_ts", delay)
    p = p.withColumn("pass_bucket", F.explode(F.sequence(bucket(F.col("entry_ts")), bucket(F.col("end_ts")))))
    f = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    f = f.withColumn("bucket", bucket(F.col("ts")))
    within = (
        (F.col("lane") == F.col("pass_lane")) & (F.col("bucket") == F.col("pass_bucket"))
        & (F.col("ts") >= F.col("entry_ts")) & (F.col("ts") <= F.col("end_ts"))
        & (F.col("ts") <= F.col("entry_ts") + sensors.interval(max_s))
    )
    return p.join(f, within).drop("pass_lane", "pass_bucket", "bucket")


def throttle_latest_stream(frames: DataFrame, every_s: float = 0.15, delay: str = "10 seconds", ends: DataFrame | None = None) -> DataFrame:
    """Newest frame per lane and closed interval."""
    timed = clocked(frames, delay, ends)
    slot = F.window("ts", f"{int(every_s * 1000)} milliseconds")
    keep = [c for c in frames.columns if c not in ("lane", "ts")]
    return timed.groupBy("lane", slot).agg(F.max_by(F.struct(*keep, "ts"), F.struct("ts", "frame_id")).alias("f")).select(
        "lane", *(F.col(f"f.{c}").alias(c) for c in keep), F.col("f.ts").cast("timestamp_ntz").alias("ts"))


def live_kpis(events: DataFrame, every: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """KPIs per lane and tumbling window, refreshed on every new event (update mode)."""
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    counts = timed.groupBy(F.window("timestamp", every).alias("w"), "lane_name").agg(
        F.count("*").alias("total"), F.count_if(F.col("admission") == 0).alias("approved"),
        F.count_if(F.col("admission") == 2).alias("denied"), F.count_if("foreign_object_detected").alias("threats"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "lane_name", "total", "approved", "denied", "threats")


def newest_events_writer(path: str, n: int = 500):
    """``foreachBatch`` writer keeping the newest ``n`` events: the old view and the batch are ranked
    together. The view is bounded by ``n``; the version before stays for replays and readers, older ones go."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if epoch > 0:
            merged = spark.read.parquet(f"{path}/v{epoch - 1}").unionByName(batch)
        reports.recent_events(merged, n).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        if epoch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{epoch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write
