"""Many K-Means fits at once: one pass over the points an iteration for all models, however many there are.

A model is (k, seed).  All models' centres travel with the pass; a task adds up its points by model and centre, Spark adds
up the tasks, and only these sums (models x k rows) reach the driver.  Starts are k-means++: the next centre of every
model is drawn with odds by squared distance, as the least of exponential variates from a hash of the point and
the round, so starts don't depend on how the points are partitioned.  For bootstrap fits each point counts as often as a
Poisson variate from the hash of point and seed says.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

# the passes travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK_ROWS = 4000  # a task's points: every pass compares each with the centres of all models
BLOCK = 2048  # points compared at once, so that their distances stay in the processor's cache


@dataclass
class Model:
    """One fit: its centres, the sum of squared distances, points per centre, and whether it is done."""

    k: int
    seed: int
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    cost: float = float("inf")
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    done: bool = False


def uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), from the points' hashes and a salt."""
    x = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def weights(h: np.ndarray, seed: int, rate: float | None) -> np.ndarray:
    """How often each point counts: once, or a Poisson variate of that mean."""
    if rate is None:
        return np.ones(len(h))
    u, term, below, out = uniform(h, 7919 * seed + 1), np.exp(-rate), 0.0, np.zeros(len(h))
    for n in range(1, 64):
        below += term
        more = u > below
        if not more.any():
            break
        out += more
        term *= rate / n
    return out


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, and coordinates with a row for each feature."""
    h = batch.column(0).to_numpy()
    return h, np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(len(h), -1).T)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points (a column each) from centres: a row for each centre."""
    out = np.zeros((len(centres), x.shape[1]))
    part = np.empty_like(out)
    for j, feature in enumerate(x):
        np.subtract(feature, centres[:, j, None], out=part)
        np.multiply(part, part, out=part)
        out += part
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point its nearest centre, the first of several, and the squared distance."""
    own, least = np.zeros(x.shape[1], np.intp), np.empty(x.shape[1])
    for s in range(0, x.shape[1], BLOCK):
        d = _distances(x[:, s:s + BLOCK], centres)
        o, best = own[s:s + BLOCK], d[0]
        for c in range(1, len(centres)):
            np.copyto(o, c, where=d[c] < best)
            np.minimum(best, d[c], out=best)
        least[s:s + BLOCK] = best
    return own, least


def _drawn(points: DataFrame, models: list[Model], salt: int, rate: float | None) -> dict[int, np.ndarray]:
    """The point each model draws next."""
    jobs = [(i, m.seed, m.centres) for i, m in enumerate(models)]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, list]] = {}
        for batch in batches:
            h, x = _points(batch)
            for i, seed, centres in jobs:
                odds = weights(h, seed, rate) * (_nearest(x, centres)[1] if len(centres) else 1.0)
                with np.errstate(divide="ignore"):
                    key = np.where(odds > 0, -np.log(uniform(h, 101 * seed + salt)) / odds, np.inf)
                at = int(np.argmin(key)) if len(key) else 0
                if len(key) and key[at] < best.get(i, (np.inf,))[0]:
                    best[i] = (float(key[at]), x[:, at].tolist())
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()),
                                              pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))], names=["model", "key", "x"])

    rows = points.mapInArrow(least, "model int, key double, x array<double>").groupBy("model").agg(F.min(F.struct("key", "x")).alias("b"))
    return {r["model"]: np.array(r["b"]["x"]) for r in rows.collect()}


def _sums(points: DataFrame, models: list[Model], dims: int, rate: float | None) -> dict[int, tuple]:
    """Per model: points, sums and cost by centre."""
    jobs = [(i, m.seed, m.centres) for i, m in enumerate(models)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((len(c), dims + 2)) for i, _, c in jobs}
        for batch in batches:
            h, x = _points(batch)
            for i, seed, centres in jobs:
                own, least = _nearest(x, centres)
                w = None if rate is None else weights(h, seed, rate)
                total[i][:, 0] += np.bincount(own, w, len(centres))
                for j, column in enumerate((least, *x), 1):
                    total[i][:, j] += np.bincount(own, column if w is None else column * w, len(centres))
        rows = [(i, c, row.tolist()) for i, t in total.items() for c, row in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["model", "centre", "s"])

    rows = points.mapInArrow(add, "model int, centre int, s array<double>").groupBy("model", "centre").agg(
        F.array(*[F.sum(F.col("s")[j]) for j in range(dims + 2)]).alias("s")).collect()
    out = {i: np.zeros((len(c), dims + 2)) for i, _, c in jobs}
    for r in rows:
        out[r["model"]][r["centre"]] = r["s"]
    return out


def fitted(points: DataFrame, models: list[tuple[int, int]], rate: float | None = None, most: int = 300,
           shift: float = 1e-4) -> list[Model]:
    """K-Means of ``points`` (h long, x array<double>) for every (k, seed).

    A model has fewer centres where there are fewer distinct points.  It ends when no centre moves by more than ``shift``.
    """
    first = points.select(F.size("x").alias("d")).first()
    all_models = [Model(k, seed) for k, seed in models]
    if first is None:
        return all_models
    dims = first["d"]
    for m in all_models:
        m.centres = np.zeros((0, dims))
    for salt in range(max((k for k, _ in models), default=0)):
        open_ = [m for m in all_models if m.k > salt]
        for i, x in _drawn(points, open_, salt, rate).items():
            open_[i].centres = np.concatenate([open_[i].centres, x[None]])
    for m in all_models:
        m.done = not len(m.centres)  # a resample without points
    for turn in range(most + 1):
        open_ = [m for m in all_models if not m.done]
        if not open_:
            break
        for i, s in _sums(points, open_, dims, rate).items():
            m = open_[i]
            m.cost, m.sizes = float(s[:, 1].sum()), s[:, 0]
            new = np.where(s[:, :1] > 0, s[:, 2:] / np.maximum(s[:, :1], 1e-300), m.centres)
            moved = np.sqrt(((new - m.centres) ** 2).sum(1)).max()
            if moved <= shift or turn == most:
                m.done = True  # cost and sizes are those of these centres
            else:
                m.centres = new
    return all_models


def silhouettes(points: DataFrame, models: list[Model]) -> list[float]:
    """Mean silhouette by squared distances of each model, from the clusters' sums: one pass for the sums, one for the points."""
    if not models or not models[0].centres.size:
        return [-1.0] * len(models)
    dims = models[0].centres.shape[1]
    sums = _sums(points, models, dims, None)
    jobs = []
    for i, m in enumerate(models):
        n, cost, total = sums[i][:, 0], sums[i][:, 1], sums[i][:, 2:]
        mean = total / np.maximum(n, 1)[:, None]
        # the mean squared distance from x to a cluster: to its mean, and the spread about it
        around = cost / np.maximum(n, 1) - ((mean - m.centres) ** 2).sum(1)
        jobs.append((i, m.centres, n, mean, around))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(jobs)), 0
        for batch in batches:
            _, x = _points(batch)
            count += x.shape[1]
            for i, centres, n, mean, around in jobs:
                own, _ = _nearest(x, centres)
                far = np.where(n[:, None] > 0, _distances(x, mean) + around[:, None], np.inf)
                rows = np.arange(x.shape[1])
                a = far[own, rows] * n[own] / np.maximum(n[own] - 1, 1)
                far[own, rows] = np.inf
                b = far.min(0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where(a < b, 1 - a / b, np.where(a > b, b / a - 1, 0.0))
                total[i] += np.where(n[own] > 1, s, 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(jobs)), pa.int32()), pa.array(total), pa.array(np.full(len(jobs), count))],
                                         names=["model", "s", "n"])

    rows = points.mapInArrow(score, "model int, s double, n long").groupBy("model").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    found = {r["model"]: r["s"] / r["n"] for r in rows if r["n"]}
    return [found.get(i, -1.0) if (m.sizes > 0).sum() > 1 else -1.0 for i, m in enumerate(models)]


def assigned(vecs: DataFrame, model: Model) -> DataFrame:
    """``vecs`` (id, features VECTOR) as (id, cluster): the nearest centre."""
    id_col = next(c for c in vecs.columns if c != "features")
    x = vector_to_array("features")
    parts = [F.aggregate(F.arrays_zip(x.alias("x"), F.array(*map(F.lit, map(float, c))).alias("c")), F.lit(0.0),
                         lambda t, p: t + (p["x"] - p["c"]) * (p["x"] - p["c"])) for c in model.centres]
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(j).alias("j")) for j, d in enumerate(parts)]))
    return vecs.select(id_col, nearest["j"].cast("int").alias("cluster"))


def as_points(vecs: DataFrame) -> DataFrame:
    """(h, x) of (id, features VECTOR), written out in even parts of about ``TASK_ROWS`` points."""
    id_col = next(c for c in vecs.columns if c != "features")
    return cut_lineage(spread(vecs.select(F.xxhash64(id_col).alias("h"), vector_to_array("features").alias("x")), rows=TASK_ROWS))
