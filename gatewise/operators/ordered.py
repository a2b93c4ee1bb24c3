"""Ordered operators over long timelines, split into chunks so no key is one task.

A lane or pass may hold a large share of all rows. Windows here run inside (key, chunk); what crosses
a chunk border is one carried row per chunk, computed from map-side combined totals.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby, repeat
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gatewise.session import cut_lineage

DAY = 86_400.0


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def time_chunk(ts: Column, seconds: float = DAY) -> Column:
    return F.floor(micros(ts) / F.lit(int(seconds * 1_000_000))).cast("long")


def seq_chunk(seq: Column, rows: int = 4096) -> Column:
    return F.floor(seq / rows).cast("long")


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], **specs: tuple[str, str]) -> DataFrame:
    """Adds ordered columns: ``name=(kind, column)`` with kind one of

    ``sum``, ``max`` (up to the row), ``max_before``, ``last`` (latest non-null up to the row),
    ``lag`` and ``lead``. ``order`` must be unique within a key and ``chunk`` monotone in it.
    """
    # A struct of nulls equals itself, so rows without a key or an order value stay.
    base = df.withColumn("_g", F.struct(*keys, chunk.alias("_chunk")))
    rank = F.struct(*order)
    inner = W.partitionBy("_g").orderBy(*order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    by_chunk = _chunks_of_key(keys)
    earlier = by_chunk.rowsBetween(W.unboundedPreceding, -1)

    totals, carries, values = [], [], {}
    for name, (kind, col) in specs.items():
        c, tot, carry = F.col(col), f"_t_{name}", f"_c_{name}"
        if kind == "sum":
            totals.append(F.sum(c).alias(tot))
            carries.append(F.sum(tot).over(earlier).alias(carry))
            zero = F.lit(0)
            values[name] = F.coalesce(F.sum(c).over(upto), zero) + F.coalesce(F.col(carry), zero)
        elif kind in ("max", "max_before"):
            totals.append(F.max(c).alias(tot))
            carries.append(F.max(tot).over(earlier).alias(carry))
            values[name] = F.greatest(F.max(c).over(upto if kind == "max" else before), F.col(carry))
        elif kind == "last":
            totals.append(F.max_by(c, F.when(c.isNotNull(), rank)).alias(tot))
            carries.append(F.last(tot, ignorenulls=True).over(earlier).alias(carry))
            values[name] = F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(carry))
        elif kind == "lag":
            totals.append(F.max_by(F.struct(c.alias("v")), rank).alias(tot))
            carries.append(F.lag(tot).over(by_chunk).alias(carry))
            values[name] = F.coalesce(F.lag(F.struct(c.alias("v"))).over(inner), F.col(carry))["v"]
        elif kind == "lead":
            totals.append(F.min_by(F.struct(c.alias("v")), rank).alias(tot))
            carries.append(F.lead(tot).over(by_chunk).alias(carry))
            values[name] = F.coalesce(F.lead(F.struct(c.alias("v"))).over(inner), F.col(carry))["v"]
        else:
            raise ValueError(f"unknown kind {kind}")
    # One row per chunk from here on.
    carried = base.groupBy("_g").agg(*totals).select("_g", *carries)
    return base.join(carried, "_g").select(*df.columns, *(v.alias(n) for n, v in values.items()))


def _chunks_of_key(keys: list[str]):
    return W.partitionBy(*(F.col("_g")[k] for k in keys)).orderBy(F.col("_g")["_chunk"])


def islands(df: DataFrame, keys: list[str], chunk: Column, order: list[str], breaks: Callable[[Column, Column], Column],
            carry: list[str], following: str | None = None) -> DataFrame:
    """Adds ``island``: the order values of the row that opened the row's island, as a struct.

    A row opens an island when it has no predecessor or ``breaks(before, row)`` holds, both structs of
    ``order`` and ``carry``. With ``following``, adds ``next_<following>`` of the row after. Everything
    comes from one pass over (key, chunk): what crosses a border is one row per chunk.
    """
    base = df.withColumn("_g", F.struct(*keys, chunk.alias("_chunk")))
    rank = lambda r: F.struct(*(r[c].alias(c) for c in order))
    opens = lambda before, row: F.when(before.isNull() | F.coalesce(breaks(before, row), F.lit(False)), rank(row))
    inner = W.partitionBy("_g").orderBy(*order)
    row, before = F.col("_row"), F.col("_before")
    marked = base.withColumn("_row", F.struct(*dict.fromkeys([*order, *carry]))).withColumn("_before", F.lag("_row").over(inner))
    if following:
        marked = marked.withColumn("_after", F.lead("_row").over(inner))
    by_chunk = _chunks_of_key(keys)
    ends = marked.groupBy("_g").agg(
        F.min_by("_row", rank(row)).alias("_first"), F.max_by("_row", rank(row)).alias("_last"),
        F.max(F.when(before.isNotNull(), opens(before, row))).alias("_start"))
    linked = ends.withColumns({"_prior": F.lag("_last").over(by_chunk), "_next": F.lead("_first").over(by_chunk)})
    linked = linked.withColumn("_latest", F.coalesce("_start", opens(F.col("_prior"), F.col("_first"))))
    linked = linked.select("_g", "_prior", "_next", F.last("_latest", ignorenulls=True).over(
        by_chunk.rowsBetween(W.unboundedPreceding, -1)).alias("_open"))
    joined = marked.join(linked, "_g").withColumn("_start", opens(F.coalesce("_before", "_prior"), row))
    upto = F.last("_start", ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, 0))
    extra = [F.coalesce("_after", "_next")[following].alias(f"next_{following}")] if following else []
    return joined.select(*df.columns, F.coalesce(upto, F.col("_open")).alias("island"), *extra)


Step = Callable[[dict | None, list, dict], tuple[list, dict]]


def fold_chunks(df: DataFrame, keys: list[str], chunk: Column, item: Column, step: Step, settings: DataFrame | None,
                default: dict, output: T.ArrayType, rest: Callable[[dict], dict]) -> DataFrame:
    """Exact ordered fold of every key, run chunk by chunk in parallel.

    ``step(state, rows, config) -> (outputs, state)`` folds ordered rows, a chunk's in as many calls as it has batches; no
    chunk is held whole. All chunks run at
    once from the machine's ``rest(config)`` state and their outputs are stored; only a chunk whose
    predecessor ended in another state than it started from is folded again. Machines that return to
    rest between chunks run once. ``settings`` (keys and any of the configuration's fields) overrides
    ``default`` key by key. Returns keys, ``_chunk`` and the exploded outputs.
    """
    chunks = df.select(*keys, chunk.alias("_chunk"), item.alias("item"))
    group = [*keys, "_chunk"]
    out_schema = T.StructType([
        *(df.schema[k] for k in keys), T.StructField("_chunk", T.LongType()), T.StructField("own", T.StringType()),
        T.StructField("start", T.StringType()), T.StructField("out", output), T.StructField("end", T.StringType()),
        T.StructField("last", T.BooleanType())])
    out_arrow = to_arrow_schema(out_schema)
    own = F.lit(None).cast("string")
    if settings is not None:
        fields = [c for c in settings.columns if c not in keys]
        own = F.to_json(F.struct(*fields))
        named = settings.select(F.struct(*keys).alias("_k"), own.alias("own"))
        chunks = chunks.withColumn("_k", F.struct(*keys)).join(named, "_k", "left").drop("_k")
    else:
        chunks = chunks.withColumn("own", own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come chunk by chunk and in order; outputs leave as they come, the end state with the last of them."""
        head = [*group, "own", "start"]
        at, state, found, config = None, None, [], default

        def told(last: bool) -> pa.RecordBatch:
            # The rest state is told as null, the same for every configuration.
            end = json.dumps(state, sort_keys=True) if last and state != rest(config) else None
            return pa.RecordBatch.from_pylist([dict(zip(head, at)) | {"out": found, "end": end, "last": last}], out_arrow)

        for batch in batches:
            if not len(batch):
                continue
            ends = [tuple(batch.column(c)[k].as_py() for c in head) for k in (0, len(batch) - 1)]
            # Rows are sorted by chunk, so a batch with equal ends holds one.
            columns = repeat(ends[0]) if ends[0] == ends[1] else zip(*(batch.column(c).to_pylist() for c in head))
            items = batch.column("item")
            names, values = [f.name for f in items.type], zip(*(c.to_pylist() for c in items.flatten()))
            for key, rows in groupby(zip(columns, (dict(zip(names, v)) for v in values)), itemgetter(0)):
                if key != at:
                    if at is not None:
                        yield told(True)
                    at, found = key, []
                    own, start = key[-2:]
                    config = default | (json.loads(own) if own else {})
                    state = json.loads(start) if start else rest(config)
                out, state = step(state, [row for _, row in rows], config)
                found += out
            if found:
                yield told(False)
                found = []
        if at is not None:
            yield told(True)

    def fold(rows: DataFrame) -> DataFrame:
        ordered = rows.select(*group, "own", "start", "item").repartition(*group).sortWithinPartitions(*group, "item")
        return ordered.mapInArrow(run, out_schema)

    nothing = F.lit(None).cast("string")
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    chunks = cut_lineage(chunks, "chunks")
    known = cut_lineage(fold(chunks.withColumn("start", nothing)), "folds")
    while True:
        wanted = known.filter("last").select(*group, "start", F.lag("end").over(by_chunk).alias("want"))
        stale = cut_lineage(wanted.filter("NOT want <=> start").select(F.struct(*group).alias("_g"), F.col("want").alias("start")), "stale")
        if stale.isEmpty():
            return known.select(*group, F.explode("out").alias("o")).select(*group, "o.*")
        keyed = chunks.withColumn("_g", F.struct(*group))
        redone = fold(keyed.join(stale, "_g").select(*chunks.columns, "start"))
        kept = known.withColumn("_g", F.struct(*group)).join(stale, "_g", "left_anti").select(known.columns)
        known = cut_lineage(kept.unionByName(redone), "folds")
