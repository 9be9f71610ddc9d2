"""Boosting against a plain top-down form; recursive forecasts against hand-rolled ones."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting, predict
from tessera.session import cut_lineage


def plain_tree(bins, residual, rows, depth):
    """Prediction of each row, by recursion over whole nodes."""
    out = {}
    total = residual[rows].sum()
    best = (1e-9, None, None)
    if depth:
        for f in range(len(bins)):
            for b in range(int(bins[f].max())):
                left = rows[bins[f, rows] <= b]
                right = rows[bins[f, rows] > b]
                if len(left) and len(right):
                    gain = (residual[left].sum() ** 2 / (len(left) + 1) + residual[right].sum() ** 2 / (len(right) + 1)
                            - total ** 2 / (len(rows) + 1))
                    if gain > best[0] + 1e-12:
                        best = (gain, f, b)
    if best[1] is None:
        return dict.fromkeys(rows.tolist(), total / (len(rows) + 1))
    f, b = best[1:]
    for part in (rows[bins[f, rows] <= b], rows[bins[f, rows] > b]):
        out |= plain_tree(bins, residual, part, depth - 1)
    return out


def frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = 3 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(0, 0.1, n)
    rows = [(*map(float, r), float(t), i, -1 if i < n // 2 else (i - n // 2) * 3 // (n - n // 2)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, label double, row_index long, test_fold long")


def test_boosting_equals_plain_trees(spark):
    table = boosting.train_table(frame(spark), ["a", "b", "c"])
    base, trees, importance, _ = boosting.boost(table, 3, 0.3, 5, None)
    now = np.full(len(table.label), table.label.mean())
    for tree in trees:
        plain = plain_tree(table.bins, table.label - now, np.arange(len(now)), 3)
        step = np.array([plain[i] for i in range(len(now))])
        assert np.allclose(tree.predict(table.bins, tree.bin, 3), step, atol=1e-9)
        now = now + 0.3 * step
    assert importance.sum() == pytest.approx(1) and importance[0] == importance.max()


def test_staged_errors_equal_shorter_fits_and_scores_of_the_model(spark):
    df = frame(spark)
    table = boosting.train_table(df, ["a", "b", "c"])
    staged = boosting.staged_errors(spark, table, [(4, 0.1, 9, 0), (2, 0.2, 9, 2)])
    for (depth, step, fold), errors in zip([(4, 0.1, 0), (2, 0.2, 2)], staged):
        base, trees, imp, own = boosting.boost(table, depth, step, 4, fold)
        assert errors[3] == pytest.approx(own[-1], rel=1e-12)
        model = boosting.BoostedModel(["a", "b", "c"], base, step, depth, trees, imp)
        scored = model.transform(df.where(F.col("test_fold") == fold))
        assert scored.select(F.sum(F.pow(F.col("label") - F.col("prediction"), 2))).first()[0] == pytest.approx(errors[3], rel=1e-9)


def test_boosting_of_constant_and_single_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0, -1)] * 3 + [(1.0, 5.0, 3, 0)], "a double, label double, row_index long, test_fold long")
    base, trees, importance, errors = boosting.boost(boosting.train_table(df, ["a"]), 3, 0.1, 2, 0)
    assert base == 5.0 and importance.tolist() == [0.0] and errors.tolist() == [0.0, 0.0]
    assert all(t.feature.tolist() == [-1] for t in trees)


def test_forecast_feeds_predictions_back(spark):
    rows = [("a", dt.datetime(2024, m, 1), float(v), 10, 0.5) for m, v in zip(range(9, 13), (1, 2, 4, 8))]
    rows += [("b", dt.datetime(2024, 12, 1), 6.0, 20, 0.1), ("b", dt.datetime(2025, 1, 1), None, 20, 0.1)]
    data = spark.createDataFrame(rows, "county_fips string, date timestamp, spending_amount double, total_trips long, member_ratio double")
    model = predict.LinearModel({"spending_lag_1": 0.5, "spending_lag_3": 0.25, "spending_ma_3": 0.3, "total_trips": 0.1}, 1.0)
    got = {(r.county_fips, r.period): (r.date, r.predicted_spending) for r in predict.forecast_spending(model, data, 6).collect()}
    for county, past, trips in (("a", [2.0, 4.0, 8.0], 10), ("b", [None, None, 6.0], 20)):
        for period in range(1, 7):
            three = past[-3:]
            mean = sum(three) / 3 if None not in three else 0.0
            value = 1 + 0.5 * three[2] + 0.25 * (three[0] or 0.0) + 0.3 * mean + 0.1 * trips
            assert got[county, period] == (dt.datetime(2025, period, 1), pytest.approx(value))
            past.append(value)
    assert len(got) == 12
    assert predict.forecast_spending(model, data.limit(0), 2).count() == 0


def test_model_of_all_rows_equals_its_trees(spark):
    df = frame(spark)
    table = boosting.train_table(df, ["a", "b", "c"])
    model = boosting.fitted(spark, table, ["a", "b", "c"], 3, 0.2, 6)
    base, trees, importance, _ = boosting.boost(table, 3, 0.2, 6, None)
    want = base + sum(0.2 * t.predict(table.bins, t.bin, 3) for t in trees)
    got = [r["prediction"] for r in model.transform(df).orderBy("row_index").collect()]
    assert got == pytest.approx(want.tolist()) and model.importance.tolist() == pytest.approx(importance.tolist())


def test_forest_search_fits_each_fold_once_and_equals_plain_fits(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor

    rng = np.random.default_rng(5)
    rows = [(f"{c:05d}", dt.datetime(2020 + m // 12, m % 12 + 1, 1), float(rng.gamma(2, 100 * (c + 1))), m // 3 % 4 + 1,
             *map(float, rng.gamma(2, 100, 3)), 100 * c, float(rng.random())) for c in range(8) for m in range(24)]
    data = spark.createDataFrame(rows, "county_fips string, date timestamp_ntz, spending_amount double, quarter long, spending_lag_1 double, "
                                       "spending_lag_3 double, spending_ma_3 double, total_trips long, member_ratio double")
    grid = {"numTrees": [5, 10], "maxDepth": [3, 8], "minInstancesPerNode": [2]}
    monkeypatch.setitem(predict.GRIDS, "random_forest", grid)
    # written in one file: the forests' samples follow the rows' order
    rows = cut_lineage(predict.time_series_folds(data).coalesce(1))
    monkeypatch.setattr(predict, "time_series_folds", lambda df, n_splits=3: rows)
    made, plain = [], predict._estimator
    monkeypatch.setattr(predict, "_estimator", lambda kind, params, seed=42: made.append(plain(kind, params, seed)) or made[-1])
    got = predict.train_spending_predictor(data, "random_forest")
    assert len(made) == 4 * 3 + 1  # a fit for each point and fold, and the best point's on all rows
    assert all(e.getCacheNodeIds() for e in made)  # no pass sends the trees

    folded = predict._design(rows).coalesce(1).persist()
    points = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": 2} for n in grid["numTrees"] for d in grid["maxDepth"]]
    found = []
    for params in points:
        scores = []
        for f in range(3):
            start = folded.where(F.col("test_fold") == f).agg(F.min("row_index")).first()[0]
            model = RandomForestRegressor(seed=42, maxMemoryInMB=1024, **params).fit(folded.where(F.col("row_index") < start))
            pred = model.transform(folded.where(F.col("test_fold") == f))
            scores.append([RegressionEvaluator(metricName=m).evaluate(pred) for m in ("mse", "r2")])
        found.append(np.array(scores))
    assert [r["mean_fold_mse"] for r in got["grid"].orderBy("grid_point").collect()] == pytest.approx([s[:, 0].mean() for s in found], rel=1e-12)
    best = int(np.argmin([s[:, 0].mean() for s in found]))
    m = got["metrics"].first()
    assert got["best_params"] == points[best]
    assert (m["cv_r2_mean"], m["cv_r2_std"]) == pytest.approx((found[best][:, 1].mean(), found[best][:, 1].std()), rel=1e-9)
    folded.unpersist()
