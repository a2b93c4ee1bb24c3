"""Starting bounded or endless runs of a streaming frame with state and output in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.session import scratch_path
from gatewise.streaming.keyed import KeyedTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Large keyed state lives in RocksDB; the session's own choice is restored afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_available(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process everything available in append mode and return what was written."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)
    with rocksdb_state(spark):
        run = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_end(spark: SparkSession, build: Callable[[DataFrame], DataFrame], name: str, delay_s: float, past_s: float = 0.0,
               arrivals: Iterable[Callable[[], None]] = (lambda: None,), checkpoint: str | None = None, out: str | None = None,
               newest: Callable[[], datetime | None] | None = None) -> DataFrame:
    """Process everything available, then close the input, so that nothing stays behind the watermark.

    ``build(ends)`` makes the stream and hands ``ends``, a stream of closing times, to ``jobs.clocked``. Every step of
    ``arrivals`` brings more input and is followed by a run that goes on from the checkpoint. When all is read, one
    closing time moves the watermark to the end of the largest event time's millisecond, or ``past_s`` beyond it, and all
    timers up to there go off. ``newest`` tells the largest event time where the watermark follows another clock.
    """
    folder, checkpoint, out = scratch_path(spark, f"{name}-ends"), checkpoint or scratch_path(spark, f"{name}-checkpoint"), out or scratch_path(spark, name)
    spark.createDataFrame([], "ts timestamp").write.parquet(folder)
    ends = spark.readStream.schema("ts timestamp").parquet(folder)
    mark = None
    for arrive in arrivals:
        arrive()
        stream = build(ends)
        mark = _available(stream, checkpoint, out) or mark
    largest = newest() if newest else mark and mark + timedelta(seconds=delay_s)
    if largest is not None:
        last = largest + timedelta(seconds=delay_s + past_s, milliseconds=1)
        spark.createDataFrame([(last,)], "ts timestamp").write.mode("append").parquet(folder)
        _available(stream, checkpoint, out)
    return spark.read.schema(stream.schema).parquet(out)


def _available(stream: DataFrame, checkpoint: str, out: str) -> datetime | None:
    """One run over what is there; the watermark it leaves, none before the first row."""
    with rocksdb_state(stream.sparkSession):
        run = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
               .outputMode("append").trigger(availableNow=True).start())
        run.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in run.recentProgress if "watermark" in p["eventTime"]]
    mark = max((datetime.fromisoformat(m) for m in marks), default=None)
    return mark if mark and mark.timestamp() > 0 else None


def run_updates(stream: DataFrame, name: str, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """Process everything available in update mode and return the present value per key."""
    spark = stream.sparkSession
    table = KeyedTable(spark, scratch_path(spark, name), keys)
    with rocksdb_state(spark):
        run = (
            stream.writeStream.foreachBatch(table.write)
            .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return table.read()
