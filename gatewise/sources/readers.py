"""Table, file and stream readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewise import schemas
from gatewise.sources import named_files


def _by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns by name: extra stored columns are ignored, absent ones are null."""
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        )
    )


def read_scan_events(spark: SparkSession, path: str) -> DataFrame:
    """Event table written by ``append_scan_events``; the event_date partition column stays for pruning."""
    schema = T.StructType([*schemas.SCAN_EVENTS.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def read_scan_events_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, parts: int, **options):
    """Parallel range read on the id, where a driver jar for the database is on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", "id").option("lowerBound", lower).option("upperBound", upper)
    for k, v in options.items():
        reader = reader.option(k, v)
    return _by_name(reader.option("numPartitions", parts).load(), schemas.SCAN_EVENTS)


def path_kind(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return "absent"
    return "folder" if fs.getFileStatus(hadoop).isDirectory() else "file"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry: one JSON array file, or a folder of JSON lines as ``write_registry`` leaves it.

    A missing, empty or unparsable file is an empty registry.
    """
    kind = path_kind(spark, path)
    if kind == "absent":
        return spark.createDataFrame([], schemas.REGISTRY)
    raw = (
        spark.read.schema(T.StructType([*schemas.REGISTRY_JSON.fields, T.StructField("_broken", T.StringType())]))
        .option("multiLine", kind == "file")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )
    return raw.filter("_broken IS NULL AND LicensePlate IS NOT NULL").select(
        F.col("Id").alias("id"),
        F.col("LicensePlate").alias("license_plate"),
        F.col("OwnerName").alias("owner_name"),
        F.col("Classification").alias("classification"),
        F.col("Notes").alias("notes"),
    )


LANE_TABLES = {
    "controllers": schemas.CONTROLLERS,
    "driver_cameras": schemas.IP_CAMERAS,
    "anpr_cameras": schemas.IP_CAMERAS,
    "underbody_cameras": schemas.UNDERBODY_CAMERAS,
}


def read_lane_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four configuration tables. Only schema columns are selected, so credentials never leave storage."""
    return {name: _by_name(spark.read.parquet(f"{path}/{name}"), schema) for name, schema in LANE_TABLES.items()}


def read_eval_tsv(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Label list (no header; lines without exactly two fields are skipped) or report file (header)."""
    if header:
        return spark.read.schema(schemas.EVAL_REPORT).csv(path, sep="\t", header=True)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 2).select(
        F.col("p")[0].alias("rel_path"),
        F.col("p")[1].alias("label"),
        F.element_at(F.split(F.col("p")[0], "/"), -1).alias("filename"),
    )


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Non-recursive listing of jpg and png files, loose or in archives, empty ones too; no image is opened."""
    named_files.register(spark)
    files = spark.read.format("named_files").option("path", path).option("endings", ".jpg,.png").load()
    return files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("filename"))


def read_loop_messages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Line stream of loop controllers: files ``<lane>/...`` (or ``lane=<lane>/...``) of
    ``<timestamp> TAB <sequence> TAB <line>``."""
    lines = (
        spark.readStream.format("text")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    parts = F.split("value", "\t", 3)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return lines.select(
        F.regexp_replace(folder, "^lane=", "").alias("lane"),
        parts[0].cast("timestamp_ntz").alias("ts"),
        parts[1].cast("long").alias("seq"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("line"),
    )


# Recorded-frame layout <lane>_<yyyyMMdd_HHmmss>/raw/NNNNN.jpg and previews NNNN_<n>f_<r>r.jpg.
_PASS_DIR = r"([^/]+)_(\d{8}_\d{6})/"


def read_frame_log(spark: SparkSession, path: str) -> DataFrame:
    """Recorded frames and previews, described by their paths only; a frame without bytes is listed too."""
    named_files.register(spark)
    files = spark.read.format("named_files").option("path", path).option("recursive", "true").option("endings", ".jpg").load()
    raw = _PASS_DIR + r"raw/(\d{5})\.jpg$"
    preview = _PASS_DIR + r"(\d{4})_(\d+)f_(\d+)r\.jpg$"
    number = lambda pattern, i: F.regexp_extract("path", pattern, i)
    is_raw = F.col("path").rlike(raw)
    is_preview = F.col("path").rlike(preview)
    return files.filter(is_raw | is_preview).select(
        F.regexp_extract("path", _PASS_DIR, 1).alias("lane"),
        F.to_timestamp_ntz(F.regexp_extract("path", _PASS_DIR, 2), F.lit("yyyyMMdd_HHmmss")).alias("started_at"),
        F.when(is_raw, F.lit("raw")).otherwise(F.lit("preview")).alias("kind"),
        F.when(is_raw, number(raw, 3)).otherwise(number(preview, 3)).try_cast("int").alias("number"),
        F.when(is_preview, number(preview, 4)).try_cast("int").alias("n_frames"),
        F.when(is_preview, number(preview, 5)).try_cast("int").alias("n_rows"),
        "length",
        "path",
    )


def read_bank(spark: SparkSession, path: str, dim: int = 384) -> DataFrame:
    """Bank of clean vectors; a vector of another length fails the read."""
    bank = spark.read.schema(schemas.BANK).parquet(path)
    message = F.concat(F.lit(f"bank vector length is not {dim}: "), F.size("feat").cast("string"))
    return bank.withColumn("feat", F.when(F.size("feat") == dim, F.col("feat")).otherwise(F.raise_error(message)))
