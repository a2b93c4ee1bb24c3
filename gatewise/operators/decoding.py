"""Reader outputs to text: run-length and stop-token decoding of per-step predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.operators.ordered import islands, seq_chunk

BLANK, MIN_REPEAT, REPEAT_FACTOR = 0, 3, 1.7
STOP_TOKEN, SKIP_TOKEN, MAX_STEPS = 97, 98, 25


def ctc_runs(steps: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """Runs of equal consecutive classes with their length and first probability, blanks dropped."""
    changed = lambda before, row: ~before["class_idx"].eqNullSafe(row["class_idx"])
    runs = islands(steps, ["read_id"], seq_chunk(F.col("t"), chunk_rows), ["t"], changed, ["class_idx"])
    return runs.filter(F.col("class_idx") != BLANK).groupBy("read_id", F.col("island.t").alias("run_start")).agg(
        F.first("class_idx").alias("class_idx"), F.count("*").cast("int").alias("run_length"),
        F.min_by("prob", "t").alias("prob"))


def run_length_threshold(runs: DataFrame) -> DataFrame:
    """Per read, the run length from which a run counts twice: max(3, round-half-even(1.7 x upper median)).

    Lengths are counted before they are ranked, so a read sends one row per distinct length.
    """
    counts = runs.groupBy("read_id", "run_length").agg(F.count("*").alias("n"))
    # Distinct lengths of one read are few (their sum is the read's steps), so this array is short.
    packed = counts.groupBy("read_id").agg(
        F.array_sort(F.collect_list(F.struct("run_length", "n"))).alias("_l"), F.sum("n").alias("_n"))
    # Upper median: the run at sorted position n div 2.
    median = F.expr(
        "aggregate(_l, named_struct('seen', CAST(0 AS BIGINT), 'm', CAST(NULL AS INT)), (a, x) -> named_struct("
        "'seen', a.seen + x.n, 'm', if(a.m IS NULL AND a.seen + x.n > _n div 2, x.run_length, a.m))).m")
    limit = F.greatest(F.lit(MIN_REPEAT), F.bround(median * F.lit(REPEAT_FACTOR), 0).cast("int"))
    return packed.select("read_id", limit.alias("repeat_threshold"))


def _joined_text(items: DataFrame, text: str, order: str, part_rows: int = 4096) -> DataFrame:
    """Text of each read in order, assembled per part of its steps and then from the parts' texts."""
    in_order = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda r: r[text]), "")
    parts = items.groupBy("read_id", F.floor(F.col(order) / part_rows).alias("_part")).agg(
        in_order(order).alias(text), F.count_if(F.col("weight") > 0).alias("_any"),
        F.sum(F.col("prob") * F.col("weight")).alias("_p"), F.sum("weight").alias("_w"))
    return parts.groupBy("read_id").agg(
        in_order("_part").alias("text"), F.sum("_any").alias("_any"), F.try_divide(F.sum("_p"), F.sum("_w")).alias("confidence"))


def ctc_text(runs: DataFrame, thresholds: DataFrame, characters: DataFrame) -> DataFrame:
    """Text and mean probability per read; runs at or above the read's threshold count twice.

    ``characters``: class_idx, ch — the fixed character list, at most a few hundred rows.
    """
    weighted = (
        runs.join(thresholds, "read_id")
        .join(F.broadcast(characters), "class_idx", "left")
        .withColumn("weight", F.when(F.col("run_length") >= F.col("repeat_threshold"), 2).otherwise(1))
        .withColumn("chars", F.repeat(F.coalesce("ch", F.lit("")), F.col("weight")))
    )
    return _joined_text(weighted, "chars", "run_start").drop("_any")


def sequence_text(steps: DataFrame, characters: DataFrame) -> DataFrame:
    """Decoder output per read: stop before the first stop token, skip padding, at most 25 steps."""
    stop = F.min(F.when(F.col("class_idx") == STOP_TOKEN, F.col("t"))).alias("_stop")
    ends = steps.filter(F.col("t") <= MAX_STEPS).groupBy("read_id").agg(stop)
    kept = (
        steps.filter(F.col("t") <= MAX_STEPS)
        .join(ends, "read_id")
        .join(F.broadcast(characters), "class_idx", "left")
        .withColumn("weight", F.when(
            (F.col("_stop").isNull() | (F.col("t") < F.col("_stop"))) & (F.col("class_idx") != SKIP_TOKEN), 1).otherwise(0))
        .withColumn("chars", F.when(F.col("weight") > 0, F.coalesce("ch", F.lit(""))).otherwise(F.lit("")))
    )
    return _joined_text(kept, "chars", "t").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).drop("_any")
