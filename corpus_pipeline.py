"""The corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.llm import mixing, ngram_join, packing, quality, substring
from gatewise.llm.common import small_batches, table
from gatewise.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word n-grams, similarity 0.8."""
    return ngram_join.keep_one(docs)


def strip_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat a passage of a document with a smaller id; n_chars follows."""
    return substring.strip_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the sources' targets ask: not at all, once or twice."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near-copies", drop_near_copies),
    ("passages", strip_passages),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing draws, a trained model and a tokenizer have no SQL. Tests hold operators against plain Python; the
#: stages as chained are held to columns, rows being there and empty input only, and keep_good and take to row counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):  # packing, too, reads texts while it is built
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = cut_lineage(docs, f"pipeline-{name}")
    return docs
