"""Many K-Means fits at once against plain Lloyd steps on arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import lloyd


def _points(spark, n=240, dims=4, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.5, (n // 4, dims)) for c in (-3, 0, 2, 6)])
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "pid long, x array<double>")
    return x, df.select(F.xxhash64("pid").alias("h"), "x").repartition(parts)


def _plain(x, centres):
    while True:
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centres)])
        if np.abs(new - centres).max() <= 1e-9:
            return ((x - centres[own]) ** 2).sum(), own
        centres = new


def test_fits_are_plain_steps(spark):
    x, points = _points(spark)
    models = lloyd.fitted(points, [(k, s) for k in (2, 4, 5) for s in (42, 43)], shift=1e-9)
    for m in models:
        cost, own = _plain(x, m.centres)
        assert m.cost == pytest.approx(cost, rel=1e-9)  # a plain step moves nothing
        assert sorted(m.sizes) == sorted(np.bincount(own, minlength=m.k))
    assert min(m.cost for m in models if m.k == 4) < 1.3 * x.shape[0] * x.shape[1] * 0.25
    got = lloyd.silhouettes(points, models)
    for m, s in zip(models, got):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        own = ((x[:, None] - m.centres) ** 2).sum(2).argmin(1)
        want = []
        for i in range(len(x)):
            mean = [d[i, own == j].sum() / ((own == j).sum() - (j == own[i])) for j in range(m.k)]
            a, b = mean[own[i]], min(v for j, v in enumerate(mean) if j != own[i])
            want.append((b - a) / max(a, b))
        assert s == pytest.approx(np.mean(want), rel=1e-6)


def test_partitioning_doesn_t_matter(spark):
    fits = [lloyd.fitted(_points(spark, parts=p)[1], [(3, 42), (5, 7)], rate=0.8) for p in (1, 5)]
    for a, b in zip(*fits):
        assert a.cost == pytest.approx(b.cost) and sorted(a.sizes) == sorted(b.sizes)


def test_resamples(spark):
    h = np.array([r["h"] for r in spark.range(20_000).select(F.xxhash64("id").alias("h")).collect()])
    w = lloyd.weights(h, 42, 0.8)
    assert abs(w.mean() - 0.8) < 0.03 and abs(w.var() - 0.8) < 0.05
    assert abs(np.corrcoef(w, lloyd.weights(h, 43, 0.8))[0, 1]) < 0.03


def test_few_points(spark):
    points = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(6)], "h long, x array<double>")
    (m,) = lloyd.fitted(points, [(4, 1)])
    assert len(m.centres) == 2 and m.cost == 0
    assert lloyd.fitted(points.limit(0), [(2, 1)])[0].cost == float("inf")


def test_points_are_dealt_over_tasks(spark):
    """Few bytes, much work: a table in one part becomes several parts, without losing or repeating a point."""
    vecs = spark.range(0, 3 * lloyd.TASK_ROWS, 1, 1).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    points = lloyd.as_points(vecs.select("id", array_to_vector("x").alias("features")))
    assert len(points.inputFiles()) == 3
    assert points.select(F.count("*"), F.sum(F.col("x")[0]), F.count_distinct("h")).first()[:] == (
        3 * lloyd.TASK_ROWS, sum(range(3 * lloyd.TASK_ROWS)), 3 * lloyd.TASK_ROWS)


def test_nearest_is_the_first_of_equal_centres():
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (2 * lloyd.BLOCK + 7, 3)).astype(float)  # many ties
    centres = rng.integers(-2, 3, (6, 3)).astype(float)
    d = ((x[:, None] - centres) ** 2).sum(2)
    own, least = lloyd._nearest(np.ascontiguousarray(x.T), centres)
    assert (own == d.argmin(1)).all() and (least == d.min(1)).all()
