"""Exact top-k by MaxScore over sharded postings.

A vector of integers is a document with two terms for each dimension: its positive and its negative part.
A query dimension of either sign has one list of postings that can raise its score, and one that only
lowers it. The raising lists are ordered by the most they can add. While the sum of the weakest lists
stays below the score that the query's k-th best document already has, a document found in none of the
others cannot enter: the weak lists are non-essential and are only probed for documents that the
essential ones brought up and that can still reach the score. Shards are searched side by side and their
results merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewise.llm.common import query, table

SHARD_ROWS, QUERY_ROWS = 8192, 4096


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as double; null where a component is null, NaN or infinite."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Postings:
    """One shard: for each dimension and sign the rows that have it, and what they have.

    A list that most rows are in is kept as a column over all rows, which adds up faster than row numbers."""

    def __init__(self, matrix: np.ndarray):
        # Doubles add and multiply whole numbers exactly as long as no sum can reach 2**53.
        largest = int(np.abs(matrix).max(initial=0))
        self.kind = np.float64 if largest * largest * max(1, matrix.shape[1]) < 1 << 53 else np.int64
        self.matrix, self.largest = matrix.astype(self.kind), largest
        self.lists, self.most = {}, {}
        for d in range(matrix.shape[1]):
            for sign in (1, -1):
                part = np.maximum(sign * matrix[:, d], 0)
                rows = np.flatnonzero(part)
                dense = 8 * len(rows) > len(part)
                self.lists[d, sign] = (None, part.astype(self.kind)) if dense else (rows, part[rows].astype(self.kind))
                self.most[d, sign] = int(part.max(initial=0))

    def _add(self, partial: np.ndarray, term: tuple) -> None:
        _, d, sign, weight = term
        rows, values = self.lists[d, sign]
        if rows is None:
            partial += weight * values
        else:
            partial[rows] += weight * values

    def search(self, query: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best by score, then smaller id; ``own`` are rows that take no part."""
        terms = [(abs(q) * self.most[d, 1 if q > 0 else -1], d, 1 if q > 0 else -1, abs(q)) for d, q in enumerate(query.tolist()) if q]
        terms = sorted((t for t in terms if t[0]), reverse=True)
        below = [0]  # the most that a list and all weaker ones can add
        for t in reversed(terms):
            below.append(below[-1] + t[0])
        below.reverse()
        query = query.astype(self.kind)
        partial, floor, done = np.zeros(len(ids), self.kind), None, 0
        looks = {len(terms) // 4, len(terms) // 2, 3 * len(terms) // 4, len(terms)}
        while done < len(terms) and (floor is None or below[done] >= floor):
            self._add(partial, terms[done])
            done += 1
            if done in looks:  # what the best so far have in full
                partial[own] = -1
                best = np.argpartition(partial, max(0, len(ids) - k - len(own)))[max(0, len(ids) - k - len(own)):]
                best = best[partial[best] >= 0]
                if len(best) >= k:
                    floor = max(int(np.partition(self.matrix[best] @ query, len(best) - k)[len(best) - k]), floor or 0)
        partial[own] = -1
        if floor is None or floor <= 0:  # a document that no list raises may still be among the best
            rows = np.flatnonzero(partial >= 0)
        else:
            rows = np.flatnonzero((partial > 0) & (partial + below[done] >= floor))
            for i in range(done, len(terms)):  # probe the non-essential lists while a document is competitive
                many = 8 * len(rows) > len(ids)
                if many:  # looking up almost every row costs more than adding the list
                    self._add(partial, terms[i])
                else:
                    _, d, sign, weight = terms[i]
                    listed, values = self.lists[d, sign]
                    if listed is None:
                        partial[rows] += weight * values[rows]
                    else:
                        partial[rows] += weight * np.maximum(sign * self.matrix[rows, d], 0)
                if not many or (i - done) % 4 == 3 or i == len(terms) - 1:
                    rows = rows[partial[rows] + below[i + 1] >= floor]
        scores = (self.matrix[rows] @ query).astype(np.int64)
        if len(rows) > 4 * k:
            few = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[few], scores[few]
        order = np.lexsort((ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def top_k(items: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "vector",
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): every query's k rows of highest inner product, ties to the smaller id.

    Both tables have an id and an array of longs. Null vectors and null ids take no part; a shorter
    vector counts as padded with zeros; rows that agree in id and vector are one row, others of
    one id each have their rank; ids are whole numbers; a row with
    the query's own id is never its result. Fewer than k candidates are all returned; without queries or
    candidates there are no rows. Sums must fit 64 bits.
    """
    def clean(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        part = df.select(df[id].cast("long").alias("id"), df[vector].alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
        part = part.groupBy("id", "v").agg(F.lit(0).alias("_")).drop("_")
        n = max(1, math.ceil(df.count() / rows))
        return part.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    docs, n_shards = clean(items, shard_rows, "shard")
    asked, n_blocks = clean(queries, query_rows, "block")
    # Every block of queries meets every shard once: whole shards and blocks are paired, never single rows.
    docs = docs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            dims = max(mine["v"].map(len).max(), theirs["v"].map(len).max())
            ids, shard = mine["id"].to_numpy(np.int64), Postings(_matrix(mine["v"], dims))
            order = np.argsort(ids)
            for qid, q in zip(theirs["id"].to_numpy(np.int64), _matrix(theirs["v"], dims)):
                own = order[np.searchsorted(ids, qid, "left", order) : np.searchsorted(ids, qid, "right", order)]
                rows, scores = shard.search(q, own, ids, k)
                out.append((np.full(len(rows), qid), ids[rows], scores))
            out = [pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*out)))))]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")

    found = docs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    # A query row meets a candidate row once, so equal rows here are different vectors of one id.
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


@query("op6_maxscore_topk", ORACLE)
def op6(spark, sf_dir):
    """The 20 best of all vectors for every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
