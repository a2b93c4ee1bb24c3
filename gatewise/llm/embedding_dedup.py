"""Near-duplicate vectors by a forest of random-projection trees.

A node splits its vectors by a random direction at the median of their projections, and what lies close to
the median on either side goes to both halves, so that a pair seldom parts. Vectors that share a leaf of any
tree are compared, in double precision; a leaf holds few vectors, and one that cannot be split, such as a
crowd of near copies, is compared in blocks by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.common import connected_components, query, table
from gatewise.session import cut_lineage

TREES, LEAF_ROWS, BLOCK_ROWS = 8, 512, 2048
#: Share of a node's vectors on either side of the median that goes both ways.
SPILL = 0.05
#: Directions and medians are fitted on so many vectors at most; every vector is routed and compared.
SAMPLE_ROWS, LEAF_SAMPLE = 16_384, 24
PAIRS_AT_ONCE = 20_000


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a component that is null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist() if isinstance(column, pa.Array) else column):
        out[i, : len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)  # neither overflow nor underflow below
    return out / np.linalg.norm(out, axis=1, keepdims=True)


class Forest:
    """Trees as rows (direction, low, high, left, right); a negative child -1 - l is leaf l."""

    def __init__(self, nodes: list, roots: list, n_leaves: int):
        self.nodes, self.roots, self.n_leaves = nodes, roots, n_leaves

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, trees: int, leaf_rows: int, spill: float, seed: int = 5) -> Forest:
        self = cls([], [], 0)
        draw, share = np.random.default_rng(seed), total / max(1, len(sample))
        for _ in range(trees):
            self.roots.append(self._grow(sample, share, leaf_rows, spill, draw))
        return self

    def _leaf(self) -> int:
        self.n_leaves += 1
        return -self.n_leaves

    def _grow(self, sample, share, leaf_rows, spill, draw, depth=0) -> int:
        if len(sample) * share <= leaf_rows or len(sample) < 2 * LEAF_SAMPLE or depth > 40:
            return self._leaf()
        direction = draw.standard_normal(sample.shape[1])
        at = sample @ direction
        low, high = np.quantile(at, [0.5 - spill, 0.5 + spill])
        left, right = sample[at <= high], sample[at >= low]
        if max(len(left), len(right)) > 0.9 * len(sample):  # near copies stay together
            return self._leaf()
        place = len(self.nodes)
        self.nodes.append(None)
        self.nodes[place] = (direction, low, high, self._grow(left, share, leaf_rows, spill, draw, depth + 1),
                             self._grow(right, share, leaf_rows, spill, draw, depth + 1))
        return place

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that every row reaches, by row and leaf."""
        rows, leaves = [], []
        stack = [(root, np.arange(len(vectors))) for root in self.roots]
        while stack:
            node, mine = stack.pop()
            if not len(mine):
                continue
            if node < 0:
                rows.append(mine)
                leaves.append(np.full(len(mine), -1 - node))
                continue
            direction, low, high, left, right = self.nodes[node]
            at = vectors[mine] @ direction
            stack += [(left, mine[at <= high]), (right, mine[at >= low])]
        rows, leaves = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]


def linked_pairs(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of x and y whose cosine reaches the threshold, a strip of x at a time."""
    for lo in range(0, len(x), 512):
        i, j = np.nonzero(x[lo : lo + 512] @ y.T >= threshold)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), PAIRS_AT_ONCE):
            yield i[a : a + PAIRS_AT_ONCE], j[a : a + PAIRS_AT_ONCE]


def near_duplicates(items: DataFrame, threshold: float = 0.9, id: str = "vec_id", vector: str = "embedding", trees: int = TREES,
                    leaf_rows: int = LEAF_ROWS, spill: float = SPILL, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``items``.

    ``n_links`` counts the other rows whose cosine is ``threshold`` or more; rows of equal vectors, also of
    one id, are rows of their own. Vectors that are null, zero or hold a null or non-finite component link
    with nothing. A null id links like any other and is never a component's name unless all its ids are
    null. Equal vectors are compared once, as one class; every other pair once, in the first leaf it shares.
    Pairs never leave their task: it returns counts and the edges of a spanning forest.
    """
    spark = items.sparkSession
    rows = items.select(items[id].alias("id"), F.when(usable(items[vector]), items[vector]).alias("vec"))
    classes = (rows.where("vec IS NOT NULL").groupBy("vec").agg(F.count("*").alias("w"), F.min("id").alias("m"))
               .select(F.xxhash64("vec").alias("v"), "vec", "w", "m"))
    classes = cut_lineage(classes, "vectors")
    total, dims = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    sample = classes.select("v", "vec").orderBy("v").limit(sample_rows).select("vec").toArrow().column("vec").combine_chunks()
    forest = Forest.fit(unit(sample, dims), total, trees, leaf_rows, spill)
    shared = spark.sparkContext.broadcast((forest.nodes, forest.roots, forest.n_leaves))  # bounded by sample_rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = Forest(*shared.value)
        sizes = np.zeros(trees_.n_leaves, np.int64)
        for batch in batches:
            if len(batch):
                sizes += np.bincount(trees_.route(unit(batch.column(0), dims))[1], minlength=len(sizes))
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used])], ["leaf", "n"])

    sizes = np.zeros(forest.n_leaves, np.int64)
    for leaf, n in classes.select("vec").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():
        sizes[leaf] = n  # a number for each leaf of the fitted forest
    parts = spark.sparkContext.broadcast(np.maximum(1, -(-sizes // block_rows)))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = Forest(*shared.value)
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                row, leaf = trees_.route(unit(batch.column(1), dims))
                first = np.searchsorted(row, np.arange(len(batch) + 1))
                mine = [leaf[a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:])]
                code = batch.column(0).to_numpy()
                n = parts.value[leaf]
                block = (code[row].view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(row)), n)
                other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                take = pa.array(row[again])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[again]), pa.array(np.minimum(block[again], other)), pa.array(np.maximum(block[again], other)), pa.array(block[again]),
                     batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(mine, pa.list_(pa.int32())).take(take)],
                    ["leaf", "lo", "hi", "block", "v", "vec", "w", "leaves"])

    kind = classes.schema["vec"].dataType.simpleString()
    scattered = classes.select("v", "vec", "w").mapInArrow(
        scatter, f"leaf long, lo long, hi long, block long, v long, vec {kind}, w long, leaves array<int>")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, lo, hi = int(pdf["leaf"].iloc[0]), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a = np.flatnonzero(pdf["block"] == lo)
        b = np.flatnonzero(pdf["block"] == hi)
        x, w = unit(pdf["vec"], dims), pdf["w"].to_numpy()
        longest = pdf["leaves"].map(len).max()
        # Leaves before this one; padding never agrees with padding.
        before = np.full((len(pdf), longest), -1, np.int64)
        for i, own in enumerate(pdf["leaves"]):
            before[i, : len(own)] = np.where(own < leaf, own, -1)
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for i, j in linked_pairs(x[a], x[b], lo == hi, threshold):
            i, j = a[i], b[j]
            left, right = before[i], before[j]
            seen = np.zeros(len(i), bool)
            for t in range(longest):
                seen |= ((left[:, t, None] == right) & (left[:, t, None] >= 0)).any(1)
            np.add.at(links, i[~seen], w[j[~seen]])
            np.add.at(links, j[~seen], w[i[~seen]])
            while True:
                low = np.minimum(root[i], root[j])
                if (root[i] == low).all() and (root[j] == low).all():
                    break
                np.minimum.at(root, root[i], low)
                np.minimum.at(root, root[j], low)
                root = root[root]
        while (root[root] != root).any():
            root = root[root]
        own = pdf["v"].to_numpy()
        used = np.flatnonzero((links > 0) | (root != np.arange(len(pdf))))
        return pd.DataFrame({"v": own[used], "links": links[used], "root": own[root[used]]})

    found = scattered.groupBy("leaf", "lo", "hi").applyInPandas(compare, "v long, links long, root long")
    found = cut_lineage(found, "links")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    parts_of = connected_components(found.where("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v")))
    member = parts_of.select(F.col("node").alias("v"), "component")
    named = classes.select("v", "w", "m").join(links, "v", "left").join(member, "v", "left").withColumn("component", F.coalesce("component", "v"))
    names = named.groupBy("component").agg(F.min("m").alias("component_id"))
    by_class = named.join(names, "component").select("v", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("v")).join(by_class, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


@query("op5_projection_forest")
def op5(spark, sf_dir):
    """All embeddings linked at a cosine of 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
