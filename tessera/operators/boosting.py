"""Boosted regression trees for a whole search grid at once.

Second-order boosting with squared error: the first prediction is the mean, each tree is grown level by level on histograms of the
residuals, a leaf is sum / (rows + L2), a split needs ``MIN_ROWS`` rows on both sides and a positive gain.

A search has few rows (one per area and month) and many fits, each a chain of thousands of short steps; as Spark jobs these
steps cost far more than their work.  So Spark runs the fits side by side, one task each, over a broadcast of the binned table.
That table's size is checked first (``fits``); a larger one takes Spark ML's boosting, which is parallel by rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# what the tasks run travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256  # of a feature
L2, MIN_ROWS = 1.0, 1
MAX_CELLS = 1 << 24  # rows x features of a broadcast table: two million months of areas with six features


@dataclass
class Tree:
    """Nodes by number: feature (-1: leaf), last bin and value that go left, left child (right is the next), leaf value."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, columns: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """Of rows given as features x rows, compared with ``cut``: ``bin`` of binned ones, ``threshold`` of values."""
        at, rows = np.zeros(columns.shape[1], np.int64), np.arange(columns.shape[1])
        for _ in range(depth):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = columns[np.maximum(f, 0), rows] > cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return self.value[at]


def grow(bins: np.ndarray, residual: np.ndarray, edges: list[np.ndarray], depth: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """One tree over features x rows of bins, the gain of its splits by feature, and how many there are."""
    n_features, n = bins.shape
    feature, cut, value, left = [-1], [0], [0.0], [0]
    gains, uses = np.zeros(n_features), np.zeros(n_features)
    first, width = 0, 1  # the level's first node and how many it has
    at, rows = np.zeros(n, np.int64), np.arange(n)  # node within the level, of the rows still in play
    for level in range(depth + 1):
        res = residual[rows]
        total, count = np.bincount(at, res, width), np.bincount(at, minlength=width)
        value[first:first + width] = (total / (count + L2)).tolist()
        if level == depth or not len(rows):
            break
        best, best_f, best_b = np.full(width, 1e-9), np.full(width, -1), np.zeros(width, np.int64)
        base = total ** 2 / (count + L2)
        for f in range(n_features):
            size = len(edges[f]) + 1
            if size < 2:
                continue
            key = at * size + bins[f, rows]
            gl = np.bincount(key, res, width * size).reshape(width, size).cumsum(1)[:, :-1]
            nl = np.bincount(key, minlength=width * size).reshape(width, size).cumsum(1)[:, :-1]
            nr = count[:, None] - nl
            gain = gl ** 2 / (nl + L2) + (total[:, None] - gl) ** 2 / (nr + L2) - base[:, None]
            gain[(nl < MIN_ROWS) | (nr < MIN_ROWS)] = -1.0
            b = gain.argmax(1)
            g = gain[np.arange(width), b]
            better = g > best
            best[better], best_f[better], best_b[better] = g[better], f, b[better]
        split = best_f >= 0
        if not split.any():
            break
        np.add.at(gains, best_f[split], best[split])
        np.add.at(uses, best_f[split], 1)
        child = np.cumsum(split) - 1  # of the split nodes
        for i in np.flatnonzero(split):
            feature[first + i], cut[first + i], left[first + i] = int(best_f[i]), int(best_b[i]), first + width + 2 * int(child[i])
        new = 2 * int(split.sum())
        feature += [-1] * new
        cut += [0] * new
        value += [0.0] * new
        left += [0] * new
        keep = split[at]
        rows, at = rows[keep], at[keep]
        at = 2 * child[at] + (bins[best_f[at], rows] > best_b[at])
        first, width = first + width, new
    feature, cut = np.array(feature), np.array(cut)
    threshold = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut)])
    return Tree(feature, cut, threshold, np.array(left), np.array(value)), gains, uses


@dataclass
class BoostedModel:
    """The fitted trees; ``transform`` adds ``prediction`` to rows with the feature columns."""

    features: list[str]
    base: float
    step: float
    depth: int
    trees: list[Tree]
    importance: np.ndarray  # mean gain of a feature's splits, as a share

    def transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast((self.base, self.step, self.depth, self.trees))

        @F.pandas_udf("double")
        def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            base, step, depth, trees = model.value
            for part in parts:
                columns = np.array([p.to_numpy(float) for p in part])
                out = np.full(columns.shape[1], base)
                for t in trees:
                    out += step * t.predict(columns, t.threshold, depth)
                yield pd.Series(out)

        return df.withColumn("prediction", scored(*[F.col(c).cast("double") for c in self.features]))


@dataclass
class Table:
    """The binned training rows: features x rows, labels, places in time order, and the fold each row tests in."""

    bins: np.ndarray
    label: np.ndarray
    index: np.ndarray
    fold: np.ndarray
    edges: list[np.ndarray]

    def split(self, fold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Training and test rows of a fold (None: all rows, none to test)."""
        if fold is None:
            return np.arange(len(self.label)), np.arange(0)
        test = np.flatnonzero(self.fold == fold)
        return np.flatnonzero(self.index < self.index[test].min()), test


def fits(df: DataFrame, features: list[str]) -> bool:
    """Whether the rows are few enough for ``train_table``."""
    return df.count() * len(features) <= MAX_CELLS


def train_table(df: DataFrame, features: list[str]) -> Table:
    """Rows (label, row_index, test_fold, features) whose size was checked, in order of their place, with features cut at quantiles."""
    probs = [(i + 1) / BINS for i in range(BINS - 1)]
    cuts = df.agg(*[F.percentile_approx(c, probs, 100 * BINS).alias(c) for c in features]).first()
    rows = df.select("label", "row_index", "test_fold", *features).orderBy("row_index").toPandas()
    x = rows[features].to_numpy(float)
    edges = [np.unique(np.array(cuts[c] or [], float)) for c in features]
    edges = [e[e < x[:, j].max()] if len(x) else e for j, e in enumerate(edges)]
    bins = np.array([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.int64).reshape(len(features), len(x))
    return Table(bins, rows["label"].to_numpy(float), rows["row_index"].to_numpy(), rows["test_fold"].to_numpy(), edges)


def boost(table: Table, depth: int, step: float, rounds: int, fold: int | None) -> tuple[float, list[Tree], np.ndarray, np.ndarray]:
    """First prediction, trees, importances, and the squared error on the fold's test rows after each tree."""
    train, test = table.split(fold)
    own, seen = np.ascontiguousarray(table.bins[:, train]), table.bins[:, test]
    y, base = table.label[train], float(table.label[train].mean())
    now, ahead = np.full(len(train), base), np.full(len(test), base)
    gains, uses, trees, error = np.zeros(len(own)), np.zeros(len(own)), [], []
    for _ in range(rounds):
        tree, g, u = grow(own, y - now, table.edges, depth)
        now += step * tree.predict(own, tree.bin, depth)
        ahead += step * tree.predict(seen, tree.bin, depth)
        gains, uses = gains + g, uses + u
        trees.append(tree)
        error.append(float(((table.label[test] - ahead) ** 2).sum()))
    mean = gains / np.maximum(uses, 1)
    return base, trees, mean / mean.sum() if mean.sum() > 0 else mean, np.array(error)


def staged_errors(spark, table: Table, jobs: list[tuple[int, float, int, int]]) -> list[np.ndarray]:
    """Squared error on the test rows after each tree, of every (depth, step, rounds, fold); one task a fit."""
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                depth, step, rounds, fold = jobs[i]
                error = boost(shared.value, depth, step, rounds, fold)[3]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([error.tolist()], pa.list_(pa.float64()))],
                                                 names=["job", "error"])

    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "job long, error array<double>").collect()
    shared.unpersist()
    return [np.array(e) for _, e in sorted((r["job"], r["error"]) for r in rows)]


def fitted(spark, table: Table, features: list[str], depth: int, step: float, rounds: int) -> BoostedModel:
    """The model of all rows, fitted in a task; only its trees come back."""
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                base, trees, importance, _ = boost(shared.value, depth, step, rounds, None)
                yield pa.RecordBatch.from_pylist([
                    {"tree": i, "feature": t.feature.tolist(), "bin": t.bin.tolist(), "threshold": t.threshold.tolist(),
                     "left": t.left.tolist(), "value": t.value.tolist(), "base": base, "importance": importance.tolist()}
                    for i, t in enumerate(trees)], schema=pa.schema([
                        ("tree", pa.int32()), ("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())),
                        ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())),
                        ("base", pa.float64()), ("importance", pa.list_(pa.float64()))]))

    rows = sorted(spark.range(0, 1, 1, 1).mapInArrow(
        run, "tree int, feature array<int>, bin array<int>, threshold array<double>, left array<int>, value array<double>, "
             "base double, importance array<double>").collect(), key=lambda r: r["tree"])
    shared.unpersist()
    trees = [Tree(*(np.array(r[c]) for c in ("feature", "bin", "threshold", "left", "value"))) for r in rows]
    return BoostedModel(features, rows[0]["base"], step, depth, trees, np.array(rows[0]["importance"]))
