"""Bank distances by metric partitioning against all pairs, and boxes and vectors with holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.operators import evidence, metric


def table(spark, vectors, name="cell"):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, feat array<double>").repartition(3)


def plain(patches, bank):
    good = [v for v in bank if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, p in enumerate(patches):
        ok = p is not None and len(p) and all(x is not None and np.isfinite(x) for x in p)
        out[i] = min(np.sqrt(((np.array(p) - np.array(b)) ** 2).sum()) for b in good) if ok else None
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i, d in want.items():
        assert (got[i] is None) == (d is None) and (d is None or abs(got[i] - d) < 1e-9), (i, got[i], d)


def clusters(rng, n, dim=6, centres=12, spread=0.05):
    at = rng.normal(size=(centres, dim)) * 3
    return at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


@pytest.fixture()
def many_partitions(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n_bank,block", [(60, 8), (900, 40)])
def test_partitioned_distance_equals_all_pairs(spark, many_partitions, n_bank, block):
    rng = np.random.default_rng(n_bank)
    bank = [*clusters(rng, n_bank).tolist(), *[[0.5] * 6] * 50]
    patches = [*clusters(rng, 150).tolist(), *rng.normal(size=(40, 6)).tolist(), bank[3], bank[3], [0.5] * 6]
    got = metric.partitioned_distance(table(spark, patches), table(spark, bank), block=block)
    same({r["cell"]: r["distance"] for r in got.collect()}, plain(patches, bank))


def test_distant_balls_are_not_met(spark, monkeypatch):
    rng = np.random.default_rng(3)
    bank, patches = clusters(rng, 1200, centres=30).tolist(), clusters(np.random.default_rng(3), 200, centres=30).tolist()
    asked = []
    meet = metric._meet
    monkeypatch.setattr(metric, "_meet", lambda a, *rest: asked.append(a.count()) or meet(a, *rest))
    got = metric.partitioned_distance(table(spark, patches), table(spark, bank))
    same({r["cell"]: r["distance"] for r in got.collect()}, plain(patches, bank))
    n_pivots = int(np.ceil(np.sqrt(1200)))
    assert asked[0] == 200 and asked[1] < 0.3 * 200 * n_pivots


def test_patches_move_by_blocks_where_no_ball_is_excluded(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bank, patches = rng.normal(size=(900, 48)).tolist(), rng.normal(size=(100, 48)).tolist()
    asked, meet = [], metric._meet
    monkeypatch.setattr(metric, "_meet", lambda a, *rest: asked.append(a.count()) or meet(a, *rest))
    got = metric.partitioned_distance(table(spark, patches), table(spark, bank), block=300)
    same({r["cell"]: r["distance"] for r in got.collect()}, plain(patches, bank))
    assert asked[0] == 100 and asked[1] <= 100 * 6


def test_whole_bank_has_every_clean_patch(spark, tmp_path):
    from gatewise.plans import scanning  # noqa: F401
    from gatewise.plans.registry import QUERIES

    rows = spark.range(4600).selectExpr("id AS vec_id", "array(float(id), float(id % 7)) AS embedding", "int(id % 10 = 9) AS label")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["s4_sample_bank"](spark, str(tmp_path)).count() == 4140
    far = {(r["image_id"], r["cell"]): r["distance"] for r in QUERIES["j5_nearest_bank_distance"](spark, str(tmp_path)).collect()}
    assert len(far) == 4600 and all((d == 0) == (cell != 9) for (_, cell), d in far.items())


@pytest.mark.parametrize("block_bytes", [1 << 20, 0])
def test_vectors_with_holes_have_no_distance(spark, block_bytes):
    bank = [[0.0, 0.0], [3.0, 4.0], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], []]
    patches = [[0.0, 1.0], None, [3.0, None], [float("nan"), 0.0], [3.0, 4.0], [float("-inf"), 2.0], []]
    got = evidence.nearest_bank_distance(table(spark, patches), table(spark, bank), block_bytes)
    same({r["cell"]: r["distance"] for r in got.collect()}, plain(patches, bank))
    empty = evidence.nearest_bank_distance(table(spark, []), table(spark, bank), block_bytes)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        evidence.nearest_bank_distance(table(spark, patches), table(spark, [None, []]), block_bytes)


@pytest.mark.parametrize("fold_limit", [8400, 1])
def test_boxes_without_an_area_stay(spark, fold_limit):
    rows = [(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 0, 0, 10, 10, 0.8), (1, 3, 0, 0, None, 10, 0.7), (1, 4, 0, 0, 10, None, 0.6), (1, 5, None, 0, 10, 10, 0.5),
            (1, 6, 0, None, 10, 10, 0.5), (1, 7, 0, 0, 0, 10, 0.4), (1, 8, 1, 0, 10, 10, 0.3), (1, 9, 50, 0, 10, 10, 0.3)]
    boxes = spark.createDataFrame(rows, "image_id int, box_id int, x int, y int, w int, h int, conf double")
    got = evidence.suppress_boxes(boxes, fold_limit=fold_limit)
    assert sorted(r["box_id"] for r in got.collect()) == [1, 3, 4, 5, 6, 7, 9]
