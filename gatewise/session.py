"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shlex
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Options of spark-submit that stand for a setting.
_OPTIONS = {"--master": "spark.master", "--driver-memory": "spark.driver.memory", "--executor-memory": "spark.executor.memory"}


def submitted_settings() -> dict[str, str]:
    """Settings that spark-submit or ``PYSPARK_SUBMIT_ARGS`` brought along."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: the JVM knows them all
        SparkContext._ensure_initialized()
        return dict(SparkConf().getAll())
    found, words = {}, shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for word, value in zip(words, words[1:]):
        if word == "--conf":
            key, _, value = value.partition("=")
            found[key] = value
        elif word in _OPTIONS:
            found[_OPTIONS[word]] = value
    return found


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with defaults for local runs; whatever the submitter set stays in force."""
    submitted = submitted_settings()
    defaults = {
        "spark.master": master,
        "spark.app.name": "gatewise",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Small local inputs still use every core.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    settings = {k: v for k, v in defaults.items() if k not in submitted}
    if CHECKPOINT_KEY not in submitted | settings and _is_local(submitted.get("spark.master", master)):
        settings[CHECKPOINT_KEY] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    builder = SparkSession.builder
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(master: str) -> bool:
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Where none is named, a local session gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not _is_local(spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder below the shared one; it goes when the driver's Python ends."""
    root = f"{shared_dir(spark)}/gatewise/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(drop_scratch, spark)
    return root


_roots: set[str] = set()


def drop_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. DataFrames made from them end with them."""
    if spark.sparkContext._jsc is None:  # stopped before
        return
    drop_folder(spark, scratch_root(spark))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder with all in it, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, name: str = "cut"):
    """Write ``df`` to the shared folder and read it back: computed once, and a lost executor costs
    a reread instead of a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
