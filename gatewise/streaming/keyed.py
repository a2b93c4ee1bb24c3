"""A table with one present row a key that a stream keeps up to date: a base, deltas, and a pointer to both."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Stored present values per key, for update-mode results.

    Every epoch writes its rows as a delta. After ``compact_after`` deltas they are merged with the base into a new one.
    What belongs together is named by a pointer file, put in place by one rename, so a reader sees the table
    of one epoch or of another, never a mixture. The two newest pointers and what they name stay, for readers and for a
    replay of the newest epoch; everything else goes. So the number of folders is bounded, whatever the number of
    epochs, and the rows kept are those of the base and of ``compact_after`` epochs.

    A replayed epoch starts from the pointer before it and leaves the same table. An epoch without rows is a delta
    without rows. Null keys are keys; of rows of one key in one epoch the largest counts.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], compact_after: int = 8):
        self.spark, self.path, self.keys, self.compact_after = spark, path.rstrip("/"), keys, compact_after
        self.hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.hadoop_path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _pointers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("pointers") if n.endswith(".json") and n[0] not in "._"]

    def _pointer(self, epoch: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{epoch:012d}.json", wholetext=True).first()[0])

    def _point(self, epoch: int, pointer: dict) -> None:
        new, name = self.hadoop_path(f"{self.path}/pointers/_{epoch:012d}.new"), self.hadoop_path(f"{self.path}/pointers/{epoch:012d}.json")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        self.fs.delete(name, False)  # only there when an epoch is replayed
        self.fs.rename(new, name)

    def _rows(self, pointer: dict) -> DataFrame:
        """The stored rows of a pointer, newest of each key, with their epoch."""
        parts = [self.spark.read.parquet(f"{self.path}/rows/{name}") for name in pointer["parts"]]
        stored = functools.reduce(DataFrame.unionByName, parts)
        keep = [c for c in stored.columns if c not in (*self.keys, "epoch")]
        newest = F.max(F.struct("epoch", *keep)).alias("v")
        return stored.groupBy(*self.keys).agg(newest).select(*self.keys, "v.*")

    def write(self, batch: DataFrame, epoch: int) -> None:
        """``foreachBatch`` writer."""
        before = max((e for e in self._pointers() if e < epoch), default=None)
        parts = self._pointer(before)["parts"] if before is not None else []
        delta = f"delta-{epoch:012d}"
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/rows/{delta}")
        pointer = {"parts": [*parts, delta]}
        if len(pointer["parts"]) > self.compact_after:
            base = f"base-{epoch:012d}"
            self._rows(pointer).write.mode("overwrite").parquet(f"{self.path}/rows/{base}")
            pointer = {"parts": [base]}
        self._point(epoch, pointer)
        self._tidy()

    def _tidy(self) -> None:
        pointers = sorted(self._pointers())
        named = {name for e in pointers[-2:] for name in self._pointer(e)["parts"]}
        old = [f"rows/{n}" for n in self._names("rows") if n not in named] + [f"pointers/{e:012d}.json" for e in pointers[:-2]]
        for name in old:
            self.fs.delete(self.hadoop_path(f"{self.path}/{name}"), True)

    def read(self) -> DataFrame:
        """The present row of every key, as of the newest epoch."""
        return self._rows(self._pointer(max(self._pointers()))).drop("epoch")
