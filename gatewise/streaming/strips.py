"""Strip plans folded epoch by epoch.

A state store is asked key by key, which costs more than the fold where passes are many and short. Here the rows of an
epoch, the rows that wait and the states of the passes meet in one shuffle by pass, sorted by time, and each partition is
folded in one run through it: Python holds a batch of rows and one state, however long a pass is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.functions import machines as M
from gatewise.operators import motion
from gatewise.operators.ordered import micros
from gatewise.session import drop_folder

# What a row of the stored tables is: the state of a pass, a frame that waits for the watermark, a strip.
STATE, HELD, STRIP = 0, 1, 2
_FIELDS = "us long, seq long, frame_rows int, dy double, go int, due double, rows int, at_top boolean"


def _schema(pass_id: T.StructField, *more: T.StructField) -> T.StructType:
    return T.StructType([pass_id, *more, *T.StructType.fromDDL(_FIELDS).fields])


def strips_writer(path: str, direction: str = "auto", delay_s: float = 10.0, idle_s: float = 3600.0) -> Callable[..., None]:
    """``foreachBatch`` writer of the strips of an epoch; ``written_strips`` reads them. Batches: pass_id, seq, ts, frame_rows, dx, dy.

    The watermark is the newest frame of the epochs before, less the delay, to the millisecond as Spark keeps it. Rows not
    newer than it are late and dropped; what the watermark that the epoch leaves has passed is folded at once. A pass of
    which nothing waits and that is silent for ``idle_s`` has ended, and its state goes. With ``last`` all that waits is
    folded, rows without a time at the end of their pass. The two newest versions of states and waiting rows stay, so a
    replayed epoch finds what it had; every epoch writes those of all passes that have not ended.
    """

    def write(batch: DataFrame, epoch: int, last: bool = False) -> None:
        spark = batch.sparkSession
        frames = batch.select(
            "pass_id", F.lit(HELD).alias("kind"), micros(F.col("ts")).alias("us"), F.col("seq").cast("long").alias("seq"),
            F.col("frame_rows").cast("int").alias("frame_rows"), F.when(F.col("dx").isNotNull(), F.col("dy")).cast("double").alias("dy"))
        mark = spark.read.schema("us long").parquet(f"{path}/marks/v{epoch - 1}").first()[0] if epoch else None
        if mark is not None:
            late = F.col("us") <= _passed(mark, delay_s)
            frames = frames.filter(F.col("us").isNull() | ~late)
        newest = frames.agg(F.max("us")).first()[0]
        mark = max((us for us in (mark, newest) if us is not None), default=None)
        passed = None if mark is None else _passed(mark, delay_s)
        schema = _schema(batch.schema["pass_id"], T.StructField("kind", T.IntegerType()))
        if epoch:
            held = _read(spark, path, batch.schema["pass_id"]).filter(F.col("epoch").eqNullSafe(epoch - 1) & (F.col("kind") != STRIP))
            every = held.select(*schema.names).unionByName(frames, allowMissingColumns=True)
        else:
            every = frames.select(*(F.col(f.name) if f.name in frames.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        order = ["pass_id", "kind", F.asc_nulls_last("us"), F.asc_nulls_last("seq"), "frame_rows", "dy"]
        folded = every.repartition("pass_id").sortWithinPartitions(*order).mapInArrow(
            _fold(motion.DIRECTIONS[direction.lower()], passed, round(idle_s * 1e6), last), schema)
        folded.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/told/epoch={epoch}")
        spark.createDataFrame([(mark,)], "us long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/v{epoch}")
        if epoch > 1:
            for old in (f"told/epoch={epoch - 2}/kind={STATE}", f"told/epoch={epoch - 2}/kind={HELD}", f"marks/v{epoch - 2}"):
                drop_folder(spark, f"{path}/{old}")

    return write


def written_strips(spark: SparkSession, path: str, pass_id: T.StructField) -> DataFrame:
    """(pass_id, seq, rows, at_top) of all epochs."""
    return _read(spark, path, pass_id).filter(F.col("kind") == STRIP).select("pass_id", "seq", "rows", "at_top")


def _read(spark: SparkSession, path: str, pass_id: T.StructField) -> DataFrame:
    places = [T.StructField(c, T.IntegerType()) for c in ("epoch", "kind")]
    return spark.read.schema(_schema(pass_id, *places)).parquet(f"{path}/told")


def _passed(mark: int, delay_s: float) -> int:
    return mark // 1000 * 1000 - round(delay_s * 1e6)


def _fold(direction: int, passed: int | None, idle_us: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ordered by pass, its state first, then its frames by time, to strips, states and frames that wait on."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, waits, go, due, until, told, types = object(), False, False, direction, 0.0, 0, [], None
        nothing = key

        def close() -> None:
            if key is not nothing and begun and (waits or passed is None or passed < until + idle_us):
                told.append((key, STATE, until, None, None, None, go, due, None, None))

        for batch in batches:
            types = batch.schema
            for pass_id, kind, us, seq, frame_rows, dy, was_going, was_due in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if pass_id != key:
                    close()
                    key, begun, waits, go, due, until = pass_id, False, False, direction, 0.0, 0
                if kind == STATE:
                    begun, go, due, until = True, was_going, was_due, us
                elif not last and (us is None or passed is None or us > passed):
                    waits = True
                    told.append((pass_id, HELD, us, seq, frame_rows, dy, None, None, None, None))
                else:
                    if begun:
                        go, due, whole = M.next_strip(go, due, dy)
                        if whole:
                            told.append((pass_id, STRIP, None, seq, None, None, None, None, M.strip_rows(whole, frame_rows), go > 0))
                    begun, until = True, until if us is None else max(until, us)
            if told:
                yield _batch(told, types)
                told.clear()
        close()
        if told:
            yield _batch(told, types)

    return fold


def _batch(rows: list, types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], names=types.names)
