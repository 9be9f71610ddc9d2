"""Spending prediction (R01-R09) with Spark ML.

The training table is one row per county × month, joined with the
county's mobility profile.  Folds follow sklearn's TimeSeriesSplit over
rows ordered by date (the reference orders by county, which leaks the
future; ordering by time is the intent).  Forests are fitted fold by fold
from a small driver thread pool; boosting runs all fits of the grid in one
Spark job (``boosting.py``).
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.spending import add_lag_features, spending_by_period
from tessera.session import cut_lineage

FEATURES = ["quarter", "spending_lag_1", "spending_lag_3", "spending_ma_3", "total_trips", "member_ratio"]
# The reference's search grids.
GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [2, 5, 10]},
    "gbt": {"maxIter": [50, 100, 200], "maxDepth": [3, 6, 9], "stepSize": [0.05, 0.1, 0.2]},
}
DRIVER_PATTERNS = {
    "mobility": ["trip", "mobility"],
    "temporal": ["hour", "day", "month", "season"],
    "demographic": ["income", "age", "education"],
}
_MODELS: dict[tuple, tuple] = {}
PARTS = 1  # partitions of the training table


def prepare_prediction_data(mobility: DataFrame, spending: DataFrame) -> DataFrame:
    """H09 → W07 → W01 → W02, inner joined with mobility."""
    lags = add_lag_features(spending_by_period(spending))
    j = mobility.join(lags, "county_fips", "inner")
    return j.select("county_fips", "date", "spending_amount", F.col("year").cast("long").alias("year"),
                    F.col("month").cast("long").alias("month"), "quarter", "season", "spending_lag_1",
                    "spending_lag_3", "spending_ma_3", "total_trips", "member_ratio")


def time_series_folds(df: DataFrame, n_splits: int = 3) -> DataFrame:
    """row_index over (date, county) and the fold each row tests in
    (-1 for rows only ever used for training).  A row's index is the number
    of rows of earlier dates (a running count over the calendar) plus its
    place among the rows of its date."""
    dates = df.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    dates = dates.select("date", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("date").orderBy("county_fips")
    r = df.join(dates, "date").withColumn("row_index", (F.col("_before") + F.row_number().over(own) - 1).cast("long"))
    r = r.select(*df.columns, "row_index")
    n = r.select(F.count(F.lit(1))).scalar()
    ts = F.floor(n / (n_splits + 1))
    start = n - n_splits * ts
    return r.withColumn("test_fold", F.when(F.col("row_index") >= start,
                                            F.floor((F.col("row_index") - start) / ts))
                        .otherwise(F.lit(-1)).cast("long"))


def _design(df: DataFrame) -> DataFrame:
    cols = [F.coalesce(F.when(F.col(c).cast("double").isin(float("inf"), float("-inf")), None)
                       .otherwise(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in FEATURES]
    x = df.select("county_fips", "date", F.col("spending_amount").alias("label"), *cols, *(
        [c for c in ("row_index", "test_fold") if c in df.columns]))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)


def _estimator(kind: str, params: dict, seed: int = 42):
    if kind == "random_forest":
        # each row keeps the node it has reached (the same trees): otherwise every pass of a deep forest sends all its trees to
        # the tasks, and the driver serializes them one job after the other
        return RandomForestRegressor(seed=seed, maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=-1, **params)
    return GBTRegressor(seed=seed, maxMemoryInMB=1024, **params)


def train_spending_predictor(data: DataFrame, kind: str = "random_forest", threads: int = 8) -> dict:
    """Grid search by mean fold MSE, refit on
    all rows, training R² and RMSE, fold R² mean / std, importances."""
    spark = data.sparkSession
    files = tuple(sorted(data.inputFiles()))
    # the same plan over the same files, or this very frame (the entry holds it, so no other can have its id)
    key = (spark.sparkContext.applicationId, kind, *((data.semanticHash(), files) if files else (id(data),)))
    if key in _MODELS:
        return _MODELS[key][1]
    folded = _design(time_series_folds(data))
    if kind == "gbt":
        folded = cut_lineage(folded.drop("features"))
        if boosting.fits(folded, FEATURES):
            out = _boosted(folded)
            _MODELS[key] = (data, out)
            return out
        folded = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(folded)
    # One row per area × month, a table bounded by geography and calendar; tree learners pay several Spark jobs per
    # iteration, whose number of tasks is what they cost.  It is fixed, as it decides the forests' seeded samples.
    folded = folded.coalesce(PARTS).persist()
    n_folds = int(folded.select(F.max("test_fold")).first()[0]) + 1
    grid = GRIDS[kind]
    combos = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    mse = RegressionEvaluator(metricName="mse")
    r2 = RegressionEvaluator(metricName="r2")
    splits = []
    for f in range(n_folds):
        start = folded.where(F.col("test_fold") == f).select(F.min("row_index")).first()[0]
        splits.append((folded.where(F.col("row_index") < start).persist(),
                       folded.where(F.col("test_fold") == f).persist()))

    if kind == "gbt":
        scores = _gbt_staged_scores(grid, combos, splits, threads)
        best = combos[min(range(len(combos)), key=lambda i: (scores[i], i))]
        with ThreadPoolExecutor(max_workers=1 + len(splits)) as pool:  # the refit and the folds' refits side by side
            whole = pool.submit(lambda: _estimator(kind, best).fit(folded))
            cv = list(pool.map(lambda s: r2.evaluate(_estimator(kind, best).fit(s[0]).transform(s[1])), splits))
            model = whole.result()
    else:
        def fold_scores(job):
            i, f = job
            train, test = splits[f]
            pred = _estimator(kind, combos[i]).fit(train).transform(test).select("label", "prediction").persist()
            try:
                return job, (mse.evaluate(pred), r2.evaluate(pred))
            finally:
                pred.unpersist()

        # every fit is a job of its own, the deepest and largest first; a fold's fit gives both its scores
        jobs = sorted(itertools.product(range(len(combos)), range(n_folds)), key=lambda j: (
            -combos[j[0]]["maxDepth"], -combos[j[0]]["numTrees"], -j[1], j[0]))
        with ThreadPoolExecutor(max_workers=threads) as pool:
            found = dict(pool.map(fold_scores, jobs))
        scores = [sum(found[i, f][0] for f in range(n_folds)) / n_folds for i in range(len(combos))]
        at = min(range(len(combos)), key=lambda i: (scores[i], i))
        best, cv = combos[at], [found[at, f][1] for f in range(n_folds)]
        model = _estimator(kind, best).fit(folded)
    out = _result(kind, model, model.transform(folded), cv, best, combos, scores, model.featureImportances.toArray())
    _MODELS[key] = (data, out)
    for part in (folded, *[p for pair in splits for p in pair]):
        part.unpersist()
    return out


def _result(kind: str, model, pred: DataFrame, cv: list[float], best: dict, combos: list[dict], scores: list[float],
            importance) -> dict:
    """R05-R07 of a finished search: metrics, grid, ranked importances, predictions of the training rows."""
    spark = pred.sparkSession
    cv_mean = sum(cv) / len(cv)
    cv_std = (sum((c - cv_mean) ** 2 for c in cv) / len(cv)) ** 0.5
    own = regression_metrics(pred).first()
    metrics = spark.createDataFrame(
        [(kind, own["r2_score"], own["rmse"], float(cv_mean), float(cv_std), str(best))],
        "model string, r2_score double, rmse double, cv_r2_mean double, cv_r2_std double, best_params string")
    ranked = sorted(zip(FEATURES, map(float, importance)), key=lambda r: (-r[1], r[0]))
    imp = spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)],
                                "feature string, importance double, rank int")
    grid_rows = [(i, str(c), float(sc), c == best) for i, (c, sc) in enumerate(zip(combos, scores))]
    grid_table = spark.createDataFrame(grid_rows, "grid_point int, params string, mean_fold_mse double, best boolean")
    return {"model": model, "metrics": metrics, "importance": imp, "best_params": best, "grid": grid_table,
            "predictions": pred.select("county_fips", "date", "label", "prediction")}


def _boosted(folded: DataFrame) -> dict:
    """The boosting grid: one fit per (depth, step, fold) at the most rounds.  The first m trees of a fit are the fit of m
    rounds, so its errors after each tree score the smaller grid points and the best one's folds as well."""
    spark, grid = folded.sparkSession, GRIDS["gbt"]
    combos = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    table = boosting.train_table(folded, FEATURES)
    n_folds = int(table.fold.max()) + 1
    shapes = sorted({(c["maxDepth"], c["stepSize"]) for c in combos}, reverse=True)  # the longest fits first
    jobs = [(depth, step, max(grid["maxIter"]), f) for depth, step in shapes for f in range(n_folds)]
    errors = dict(zip([(d, s, f) for d, s, _, f in jobs], boosting.staged_errors(spark, table, jobs)))
    test = [table.label[table.fold == f] for f in range(n_folds)]

    def fold_errors(c: dict) -> list[float]:
        return [float(errors[c["maxDepth"], c["stepSize"], f][c["maxIter"] - 1]) for f in range(n_folds)]

    scores = [sum(e / len(y) for e, y in zip(fold_errors(c), test)) / n_folds for c in combos]
    best = combos[min(range(len(combos)), key=lambda i: (scores[i], i))]
    cv = [1 - e / float(((y - y.mean()) ** 2).sum()) for e, y in zip(fold_errors(best), test)]
    model = boosting.fitted(spark, table, FEATURES, best["maxDepth"], best["stepSize"], best["maxIter"])
    return _result("gbt", model, model.transform(folded), cv, best, combos, scores, model.importance)


def _gbt_staged_scores(grid: dict, combos: list[dict], splits, threads: int) -> list[float]:
    """Fold-mean MSE for every GBT grid point from one fit per (depth,
    step, fold) at the largest ``maxIter``: with subsampling off, boosting
    is deterministic and the first m trees are exactly the m-iteration
    model, so ``evaluateEachIteration`` on the test fold (squared error per
    iteration count) scores every smaller ``maxIter`` too."""
    top = max(grid["maxIter"])
    keys = sorted({(c["maxDepth"], c["stepSize"]) for c in combos})

    def staged(job):
        (depth, step), (tr, te) = job
        m = _estimator("gbt", {"maxIter": top, "maxDepth": depth, "stepSize": step}).fit(tr)
        return m.evaluateEachIteration(te, "squared")

    # every fit is a long chain of short jobs: all of them at once keep the executors busy
    jobs = [(key, split) for key in keys for split in splits]
    with ThreadPoolExecutor(max_workers=max(threads, len(jobs))) as pool:
        scores = list(pool.map(staged, jobs))
    curves = {key: [s for (k, _), s in zip(jobs, scores) if k == key] for key in keys}
    out = []
    for c in combos:
        per_fold = curves[(c["maxDepth"], c["stepSize"])]
        out.append(sum(f[c["maxIter"] - 1] for f in per_fold) / len(per_fold))
    return out


def predict_spending(model, data: DataFrame) -> DataFrame:
    """Score the given rows (the reference's ``periods`` argument has
    no effect; rows in, one prediction per row out)."""
    x = _design(data)
    return model.transform(x).select("county_fips", "date", F.col("prediction").alias("predicted_spending"))


@dataclass(frozen=True)
class LinearModel:
    """A model with given weights: ``prediction`` = intercept + weighted sum of the columns."""

    weights: dict[str, float]
    intercept: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(self.intercept)
        for c, w in self.weights.items():
            total = total + F.lit(w) * F.col(c)
        return df.withColumn("prediction", total)


def forecast_spending(model, data: DataFrame, periods: int = 6) -> DataFrame:
    """R08 over several periods: (county_fips, period, date, predicted_spending) for the ``periods`` months after each
    county's last one.

    Every month's prediction is the next month's lag: the state is one row per county with its last three amounts, scored
    and shifted once a period, so a county's history is read once and nothing but the state moves.  The moving average of a
    month to come is that of the three months before it.  Rows without an amount or a date don't count; a county
    with fewer than three months has missing lags, which count as zero as in training; no rows, no forecast.
    """
    if periods < 1:
        raise ValueError("periods must be >= 1")
    known = data.where(F.col("spending_amount").isNotNull() & F.col("date").isNotNull())
    newest = Window.partitionBy("county_fips").orderBy(F.desc("date"))
    last = known.withColumn("_age", F.row_number().over(newest)).where("_age <= 3")

    def at(age: int, c: str):
        return F.max(F.when(F.col("_age") == age, F.col(c))).alias(f"_{c}_{age}" if c == "spending_amount" else c)

    state = cut_lineage(last.groupBy("county_fips").agg(
        at(1, "date"), at(1, "total_trips"), at(1, "member_ratio"), *[at(a, "spending_amount") for a in (1, 2, 3)]))
    kind = state.schema["date"].dataType
    one, two, three = (F.col(f"_spending_amount_{a}") for a in (1, 2, 3))
    out = None
    for period in range(1, periods + 1):
        ahead = state.withColumn("date", F.add_months(F.col("date").cast("date"), 1).cast(kind)).select(
            "*", F.quarter("date").cast("long").alias("quarter"), one.alias("spending_lag_1"), three.alias("spending_lag_3"),
            ((one + two + three) / 3).alias("spending_ma_3"), one.alias("spending_amount"))
        scored = model.transform(_design(ahead)).select("county_fips", F.col("prediction").alias("_next"))
        state = cut_lineage(ahead.join(scored, "county_fips").select(
            "county_fips", "date", "total_trips", "member_ratio", F.col("_next").alias("_spending_amount_1"),
            one.alias("_spending_amount_2"), two.alias("_spending_amount_3")))
        rows = state.select("county_fips", F.lit(period).alias("period"), "date", one.alias("predicted_spending"))
        out = rows if out is None else out.unionByName(rows)
    return out


def prediction_drivers(importance: DataFrame) -> DataFrame:
    """Importance summed per driver group by substring match on the
    feature name (a feature may count in several groups)."""
    name = F.lower(F.col("feature"))
    aggs = []
    for grp, pats in DRIVER_PATTERNS.items():
        hit = None
        for p in pats:
            c = name.contains(p)
            hit = c if hit is None else (hit | c)
        aggs.append(F.struct(F.lit(grp).alias("driver_group"),
                             F.coalesce(F.sum(F.when(hit, F.col("importance"))), F.lit(0.0)).alias("importance")))
    return importance.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R06 as a formula in one aggregate: R² = 1 - SSE / SST with
    SST = Σy² - (Σy)²/n, RMSE = sqrt(SSE / n)."""
    y, p = F.col(label), F.col(prediction)
    n, sy, syy = F.count(y), F.sum(y), F.sum(y * y)
    sse = F.sum((y - p) * (y - p))
    return pred.agg((1 - sse / (syy - sy * sy / n)).alias("r2_score"), F.sqrt(sse / n).alias("rmse"))
