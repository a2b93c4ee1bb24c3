"""Late rows as a side output: a stream is split ahead of the watermark.

Spark drops what is older than the watermark without a word. Here every epoch is split first, by the largest event
time of the epochs before it, and both halves are written in one commit. Accepted rows carry that time as ``clock``;
a job that is timed by it (``jobs.clocked``) holds the same watermark as the split and drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise.operators.ordered import micros


def split_writer(path: str, delay_s: float, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer to ``path/rows/epoch=../late=..``.

    A row is late when it is not newer than the high-water mark of the epochs before, less the delay. The mark of
    each epoch is stored, the two newest stay; a replayed epoch finds the mark it had and writes the same rows
    again. Rows without a time are accepted, as Spark does.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("mark long").parquet(f"{path}/marks/v{epoch - 1}").first() if epoch else None
        mark = before["mark"] if before else None
        batch = batch.persist()
        try:
            us = micros(F.col(ts))
            late = F.lit(False) if mark is None else F.coalesce(us <= mark // 1000 * 1000 - round(delay_s * 1e6), F.lit(False))
            clock = F.lit(None).cast("timestamp") if mark is None else F.timestamp_micros(F.lit(mark))
            (batch.withColumns({"clock": clock, "epoch": F.lit(epoch), "late": late}).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "late").parquet(f"{path}/rows"))
            newest = batch.agg(F.max(us).alias("mark"))
            newest.select(F.greatest("mark", F.lit(mark).cast("long")).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/v{epoch}")
        finally:
            batch.unpersist()
        if epoch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks/v{epoch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def newest(spark: SparkSession, path: str) -> datetime | None:
    """The high-water mark of all epochs so far."""
    marks = spark.read.schema("mark long").option("recursiveFileLookup", True).parquet(f"{path}/marks")
    return marks.agg(F.timestamp_micros(F.max("mark")).alias("t")).first()["t"]


def _schema(rows: T.StructType) -> T.StructType:
    return T.StructType([*rows.fields, T.StructField("clock", T.TimestampType()), T.StructField("epoch", T.IntegerType()), T.StructField("late", T.BooleanType())])


def accepted_stream(spark: SparkSession, path: str, rows: T.StructType) -> DataFrame:
    """The accepted rows as a stream, with their ``clock``; it may start before the first row is split."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.readStream.schema(_schema(rows)).parquet(f"{path}/rows").filter("NOT late").drop("epoch", "late")


def rejected(spark: SparkSession, path: str, rows: T.StructType) -> DataFrame:
    """All late rows, with the epoch in which they came."""
    return spark.read.schema(_schema(rows)).parquet(f"{path}/rows").filter("late").drop("clock", "late")
