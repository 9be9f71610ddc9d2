"""Nearest neighbours against all distances, with crowds at every scale."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbors
from tessera.operators.neighbors import knn_join


def brute(points, targets, k, exclude_self):
    out = {}
    for pid, x, y in points:
        near = sorted((float(np.sqrt((tx - x) ** 2 + (ty - y) ** 2)), tid) for tid, tx, ty in targets
                      if not (exclude_self and tid == pid))
        out[pid] = near[:k]
    return out


def asked(spark, points, targets, k, exclude_self):
    p = spark.createDataFrame(points, "pid long, x double, y double")
    t = spark.createDataFrame(targets, "tid long, x double, y double")
    got = {pid: [] for pid, _, _ in points}
    for r in sorted(knn_join(p, t, k, exclude_self=exclude_self).collect(), key=lambda r: (r["pid"], r["rank"])):
        got[r["pid"]].append((r["dist"], r["tid"]))
        assert r["rank"] == len(got[r["pid"]])
    return got


def crowds(seed):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.uniform(0, 1, (60, 2)), 0.5 + rng.normal(0, 1e-7, (150, 2)), np.full((80, 2), 0.25),
                         np.round(rng.uniform(-3, 3, (80, 2))), [[1e6, -1e6], [-0.0, 0.0], [0.0, -0.0]]])
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]


@pytest.mark.parametrize("k,exclude_self", [(1, False), (3, True), (40, True)])
def test_crowds_and_ties_equal_all_distances(spark, k, exclude_self):
    pts = crowds(4)
    want, got = brute(pts, pts, k, exclude_self), asked(spark, pts, pts, k, exclude_self)
    for pid, near in want.items():
        assert [t for _, t in got[pid]] == [t for _, t in near], pid
        assert [d for d, _ in got[pid]] == pytest.approx([d for d, _ in near])


def test_other_targets_far_away_and_few(spark):
    pts = crowds(5)[:90]
    for targets in ([(7, 3.0, 4.0)], [(i, 1e9 + i * 1e-3, -1e9) for i in range(70)]):
        want, got = brute(pts, targets, 3, False), asked(spark, pts, targets, 3, False)
        assert {p: [t for _, t in n] for p, n in got.items()} == {p: [t for _, t in n] for p, n in want.items()}


def test_rows_without_coordinates_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, float("inf")), (5, 2.0, 0.0)],
                                 "pid long, x double, y double")
    got = knn_join(rows, rows.withColumnRenamed("pid", "tid"), 2, exclude_self=True).collect()
    assert sorted((r["pid"], r["tid"]) for r in got) == [(1, 5), (5, 1)]
    assert knn_join(rows, rows.withColumnRenamed("pid", "tid").limit(0), 1).count() == 0
    assert knn_join(rows.limit(0), rows.withColumnRenamed("pid", "tid"), 1).count() == 0


def test_one_spot_and_a_crowded_corner_make_few_pairs(spark):
    """20,000 points on one spot, 20,000 within 1e-9 of another, 500 apart: cells hold few places, queries few cells."""
    spot = spark.range(20_000).select(F.col("id").alias("pid"), F.lit(0.3).alias("x"), F.lit(0.3).alias("y"))
    corner = spark.range(20_000, 40_000).select(F.col("id").alias("pid"), (0.7 + F.rand(1) * 1e-9).alias("x"), (0.7 + F.rand(2) * 1e-9).alias("y"))
    apart = spark.range(40_000, 40_500).select(F.col("id").alias("pid"), F.rand(3).alias("x"), F.rand(4).alias("y"))
    every = neighbors.cut_lineage(spot.unionByName(corner).unionByName(apart))
    places = every.select(F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    tree, homes = neighbors._tree(places)
    assert homes.count() == places.count()
    assert homes.groupBy("cell").count().agg(F.max("count")).first()[0] <= neighbors.LEAF
    queries = places.withColumnsRenamed({"tx": "px", "ty": "py"})
    cells = neighbors._near_cells(queries, tree, 4)
    assert cells.groupBy("px", "py").count().agg(F.max("count")).first()[0] <= 64
    got = knn_join(every, every.withColumnRenamed("pid", "tid"), 3, exclude_self=True)
    assert got.count() == 3 * 40_500
    assert {tuple(r) for r in got.where("pid < 3").select("pid", "tid").collect()} == {
        (0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (2, 3)}
