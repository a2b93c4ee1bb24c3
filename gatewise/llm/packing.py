"""Harmonic packing into sequences of a fixed capacity C.

A piece of length l is of class k when C / (k + 1) < l <= C / k, and k pieces of that class always fit one
sequence: a sequence is known from a piece's number within its class, with no search for room. What a
class wastes is cut off beforehand: a piece much shorter than C / k gives up a head of exactly C / (k + 1)
and its tail, much shorter, is classed anew. The few sequences that a class could not fill are taken
apart at the end and packed first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.llm.common import give_back, query, table
from gatewise.llm.tokens import PieceEncoder, default_tokenizer
from gatewise.session import cut_lineage

CAPACITY = 2048
#: A piece stays whole if it wastes less than this part of its class, or if its class is 1 / SLACK or above: then
#: k pieces waste less than one piece more would fill.
SLACK = 1 / 64
END_ID = 1


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces a document of this length is cut into, in order."""
    out, last = [(capacity, 1)] * (length // capacity), int(1 / slack)
    rest = length % capacity
    while rest:
        k = capacity // rest
        room = capacity // k
        if k >= last or rest >= room * (1 - slack):
            out.append((rest, k))
            break
        head = capacity // (k + 1)
        out.append((head, k + 1))
        rest -= head
    return out


def tokenized_pieces(docs: DataFrame, text: str, id: str, tokenizer: str, capacity: int, slack: float) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, class) of every piece; a text's ids never leave its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, plans = PieceEncoder(tokenizer), {}
        tail = np.array([END_ID], np.uint32).tobytes()
        for batch in batches:
            rows, starts, lengths, crcs, totals, classes = [], [], [], [], [], []
            for row, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids, at = memoryview(ids + tail), 0
                n = len(ids) // 4
                full = n - n % capacity
                if n % capacity not in plans:
                    plans[n % capacity] = cuts(n % capacity, capacity, slack)
                for length, k in [(capacity, 1)] * (full // capacity) + plans[n % capacity]:
                    rows.append(row)
                    starts.append(at)
                    lengths.append(length)
                    crcs.append(zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    totals.append(n)
                    classes.append(k)
                    at += length
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *numbers, pa.array(classes, pa.int32())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "class"])
        del encoder
        give_back()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int")


def first_fit(capacity: int):
    """Packs one class-independent remainder: at most (k - 1) pieces of every class k, whatever the input.

    Above 1 / SLACK there are only the classes of the lengths below SLACK * capacity, 31 by default."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "piece"], ascending=[False, True]).reset_index(drop=True)
        room = np.full(len(pdf), capacity, np.int64)
        bins, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for i, length in enumerate(pdf["length"]):
            b = int(np.argmax(room >= length))
            bins[i], offsets[i] = b, capacity - room[b]
            room[b] -= length
        return pdf.assign(bin=bins, offset=offsets)[["piece", "bin", "offset"]]

    return run


def pack(docs: DataFrame, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, slack: float = SLACK,
         tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece.

    Every document ends with ``END_ID``; a null or empty text is that id alone. A null id and repeated
    rows are documents of their own; an empty table gives no rows; columns that are not named are
    ignored. Sequence ids count from 0 without gaps.
    """
    pieces = tokenized_pieces(docs, text, id, tokenizer or default_tokenizer(), capacity, slack)
    pieces = cut_lineage(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    # Numbering within a class: pieces are spread over groups, each group starts where those before it end.
    groups = 4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = pieces.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("int"))
    counts = spread.groupBy("class", "g").agg(F.count("*").alias("n"))
    per_class = W.partitionBy("class")
    starts = counts.select("class", "g", (F.sum("n").over(per_class.orderBy("g")) - F.col("n")).alias("before"), F.sum("n").over(per_class).alias("all"))
    first, n_full = {}, 0
    for k, n in counts.groupBy("class").agg(F.sum("n")).orderBy("class").collect():  # a row for each class
        first[k], n_full = n_full, n_full + n // k
    first_bin = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("class")) if first else F.lit(0)
    rank = F.row_number().over(W.partitionBy("class", "g").orderBy("piece")) - 1
    numbered = spread.withColumn("rank", rank).join(starts, ["class", "g"]).withColumn("number", F.col("before") + F.col("rank"))
    numbered = cut_lineage(numbered.drop("g", "rank", "before"), "numbered")

    full = F.floor(F.col("all") / F.col("class")) * F.col("class")
    # Of the last class pieces differ in length, so their places follow from those before them.
    slot = F.floor(F.col("number") / F.col("class"))
    in_bin = W.partitionBy("class", "slot").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    filled = (numbered.where(F.col("number") < full).withColumn("slot", slot)
              .withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
              .withColumn("sequence_id", first_bin + F.col("slot")))
    left = numbered.where(F.col("number") >= full)
    fitted = (left.select("piece", "length", F.lit(0).alias("all_left")).groupBy("all_left")
              .applyInPandas(first_fit(capacity), "piece long, bin long, offset long"))
    rest = left.join(fitted, "piece").withColumn("sequence_id", F.col("bin") + n_full)
    names = [F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return filled.select(*names).union(rest.select(*names))


@query("op7_harmonic_packing")
def op7(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
