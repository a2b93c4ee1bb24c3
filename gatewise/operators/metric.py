"""Exact nearest distances to a bank of any size, by metric partitioning.

A few bank vectors are pivots, and every bank vector belongs to the ball of its nearest pivot. A patch first meets its
own pivot's ball, which gives a distance. Another ball can only win if the triangle inequality allows it: the ball's
shell of distances to its pivot must come closer to the patch's own distance to that pivot than the distance found.
Only those balls are met in the second step.

Balls and the patches that ask for them meet in blocks of bounded size, dealt by hash, so neither a ball that holds
a large share of the bank nor a popular one becomes a task of its own. In the second step small balls share a block and a
patch goes once to each block with a ball that may win, not once to each ball: where balls are too alike to be excluded,
as in many dimensions, it moves as often as the bank has blocks. The driver sees the pivots and two numbers a ball,
never the bank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.session import cut_lineage

#: Pivots at most, and vectors of one side that meet at a time.
MAX_PIVOTS, BLOCK_ROWS = 256, 8192
#: Numbers in a product of patches and bank vectors at most.
PRODUCT = 1 << 21
#: Share by which bounds are widened, so that rounding never excludes a ball.
SLACK = 1e-9


def usable(feat: Column) -> Column:
    """A vector with components, all of them finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(feat) > 0) & ~F.exists(feat, bad), F.lit(False))


def stacked(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != dim * len(column):
        raise ValueError(f"vectors must have {dim} components")
    return flat.reshape(len(column), dim)


def nearest_rows(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Distance of each row of ``x`` to the nearest row of ``known``. The product only ranks; the distance itself
    is taken directly, without cancellation."""
    out = np.empty(len(x))
    square = (known * known).sum(axis=1)
    step = max(1, min(1024, PRODUCT // max(1, len(known))))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        product = part @ known.T
        product *= -2.0
        product += square
        best = known[product.argmin(axis=1)]
        out[at : at + step] = np.sqrt(((part - best) ** 2).sum(axis=1))
    return out


class Balls:
    """Pivots, and of each ball its size and the least and largest distance of a member to the pivot."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.rows = np.zeros(len(pivots), np.int64)
        self.low, self.high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1))

    def least(self, to_pivot: np.ndarray) -> np.ndarray:
        """Bound below of the distance to any member, for each patch and ball; no bound for an empty ball."""
        bound = np.maximum(np.maximum(to_pivot - self.high, self.low - to_pivot), 0.0)
        return np.where(self.rows > 0, bound, np.inf)


def _in_balls(known: DataFrame, balls: Balls) -> DataFrame:
    """(ball, away, feat) of every bank vector."""
    shared = known.sparkSession.sparkContext.broadcast(balls.pivots)  # at most MAX_PIVOTS vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Balls(shared.value)
        for batch in batches:
            if len(batch):
                away = own.distances(stacked(batch.column(0), own.pivots.shape[1]))
                ball = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ball.astype(np.int32)), pa.array(away[np.arange(len(ball)), ball]), batch.column(0)], ["ball", "away", "feat"])

    return known.select("feat").mapInArrow(place, "ball int, away double, feat array<double>")


def _parts(counts: dict[int, int], block: int) -> Column:
    """Number of blocks of a ball, from its number of rows."""
    entries = [x for ball, n in counts.items() for x in (F.lit(ball), F.lit(-(-n // block)))]
    return F.coalesce(F.element_at(F.create_map(*entries).cast("map<int,int>"), F.col("ball")), F.lit(1)) if entries else F.lit(1)


def _meet(asked: DataFrame, members: DataFrame, rows: dict[int, int], block: int) -> DataFrame:
    """(row, distance): the nearest member of the balls that a row asks for. ``asked``: row, ball, feat."""
    wanted = {r["ball"]: r["n"] for r in asked.groupBy("ball").agg(F.count("*").alias("n")).collect()}  # MAX_PIVOTS rows
    mine, theirs = _parts(wanted, block), _parts(rows, block)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")  # noqa: E731  (keys of both sides need one type)
    left = asked.withColumn("p", dealt("row", mine)).withColumn("b", every(theirs))
    right = members.filter(F.col("ball").isin(list(wanted))).withColumn("b", dealt("feat", theirs)).withColumn("p", every(mine))

    def least(patches: pa.Table, bank: pa.Table) -> pa.Table:
        if not len(patches) or not len(bank):
            return pa.table({"row": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        known = bank["feat"].combine_chunks()
        dim = len(known[0])
        found = nearest_rows(stacked(patches["feat"].combine_chunks(), dim), stacked(known, dim))
        return pa.table({"row": patches["row"], "distance": pa.array(found)})

    key = ["ball", "p", "b"]
    met = left.select(*key, "row", "feat").groupBy(*key).cogroup(right.select(*key, "feat").groupBy(*key)).applyInArrow(least, "row long, distance double")
    return met.groupBy("row").agg(F.min("distance").alias("distance"))


def partitioned_distance(patches: DataFrame, known: DataFrame, max_pivots: int = MAX_PIVOTS, block: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``distance`` to every patch: the least Euclidean distance to a vector of ``known`` (feat, usable vectors only).

    A patch without a usable vector gets null. Equal vectors of the bank are one.
    """
    spark = patches.sparkSession
    bank = cut_lineage(known.select(F.col("feat").cast("array<double>").alias("feat")).distinct(), "bank")
    n = bank.count()
    if not n:
        raise ValueError("bank is empty")
    chosen = bank.orderBy(F.xxhash64("feat")).limit(int(np.clip(np.ceil(np.sqrt(n)), 1, max_pivots))).toArrow()
    balls = Balls(np.array(chosen["feat"].to_pylist()))
    members = cut_lineage(_in_balls(bank, balls), "balls")
    for r in members.groupBy("ball").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect():
        balls.rows[r["ball"]], balls.low[r["ball"]], balls.high[r["ball"]] = r["n"], r["lo"], r["hi"]
    rows = {i: int(k) for i, k in enumerate(balls.rows) if k}
    shared = spark.sparkContext.broadcast(balls)
    numbered = cut_lineage(patches.withColumn("_row", F.monotonically_increasing_id()), "patches")
    asking = numbered.filter(usable(F.col("feat"))).select(F.col("_row").alias("row"), F.col("feat").cast("array<double>").alias("feat"))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = shared.value
                away = own.distances(stacked(batch.column(1), own.pivots.shape[1]))
                away[:, own.rows == 0] = np.inf
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(away.argmin(axis=1).astype(np.int32)), batch.column(1)], ["row", "ball", "feat"])

    # Pieces of balls in blocks of at most ``block`` rows: (ball, piece) to block.
    pieces, room = {}, 0
    blocks: list[list[int]] = []
    for ball, size in rows.items():
        pieces[ball] = -(-size // block)
        for _ in range(pieces[ball]):
            need = -(-size // pieces[ball])
            if not blocks or need > room:
                blocks.append([])
                room = block
            blocks[-1].append(ball)
            room -= need
    sizes = {i: 0 for i in range(len(blocks))}
    places, at = [], dict.fromkeys(rows, 0)
    for i, held in enumerate(blocks):
        for ball in held:
            places.append((ball, at[ball], i))
            at[ball] += 1
            sizes[i] += -(-rows[ball] // pieces[ball])
    held_by = spark.sparkContext.broadcast([np.unique(held) for held in blocks])

    def rivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part, own = batch.slice(start, 1024), shared.value
                away = own.distances(stacked(part.column(2), own.pivots.shape[1]))
                home_ball = np.where(own.rows == 0, np.inf, away).argmin(axis=1)
                found = part.column(1).to_numpy(zero_copy_only=False)
                # As large as the numbers the bound was made from, so that rounding keeps a ball rather than drops it.
                may = own.least(away) <= found[:, None] + SLACK * (1 + away + np.where(own.rows > 0, own.high, 0))
                may[np.arange(len(may)), home_ball] = False
                for i, held in enumerate(held_by.value):
                    at = pa.array(np.flatnonzero(may[:, held].any(axis=1)))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.full(len(at), i, np.int32)), part.column(2).take(at)], ["row", "ball", "feat"])

    first = cut_lineage(_meet(asking.mapInArrow(home, "row long, ball int, feat array<double>"), members, rows, block), "nearest-home")
    still = asking.join(first, "row").select("row", "distance", "feat").mapInArrow(rivals, "row long, ball int, feat array<double>")
    placed = spark.createDataFrame(places, "ball int, piece int, block int")  # MAX_PIVOTS rows and one for each block
    piece = members.withColumn("piece", F.pmod(F.xxhash64("feat", F.lit(1)), _parts(rows, block)).cast("int"))
    blocked = cut_lineage(piece.join(F.broadcast(placed), ["ball", "piece"]).select(F.col("block").alias("ball"), "feat"), "blocks")
    second = _meet(cut_lineage(still, "rivals"), blocked, sizes, 2 * block)
    both = first.union(second).groupBy("row").agg(F.min("distance").alias("distance")).withColumnRenamed("row", "_row")
    return numbered.join(both, "_row", "left").select(*patches.columns, "distance")
