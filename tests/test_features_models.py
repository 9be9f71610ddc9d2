"""Feature, metric, persona and model properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, metrics, personas, prep, spending
from tessera.functions.stats import grouped_quantiles


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 20, 101).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", 1.0), ("b", 4.0)], "k string, v double")
    q = {r.k: r for r in grouped_quantiles(df, ["k"], "v", {"med": 0.5, "p33": 0.33}).collect()}
    assert q["a"].med == pytest.approx(np.median(vals))
    assert q["a"].p33 == pytest.approx(np.quantile(vals, 0.33))
    assert q["b"].med == pytest.approx(2.5)


def test_spending_shares_sum_to_one(spark):
    rows = [(f"0000{c}", 2023, m, cat, float(100 * (c + 1) + m + i))
            for c in range(3) for m in range(1, 13) for i, cat in enumerate(["restaurants", "retail", "grocery"])]
    sp = spark.createDataFrame(rows, "county_fips string, year int, month int, category string, spending_amount double")
    cats = ["grocery", "restaurants", "retail"]
    p = spending.add_spending_proportions(spending.pivot_spending(sp, cats), cats)
    for r in p.collect():
        assert sum(r[f"spending_pct_{c}"] for c in cats) == pytest.approx(1.0)
    trend = spending.spending_trend(sp).collect()
    assert all(r.spending_trend == pytest.approx(3.0) for r in trend)  # slope of month sums: 3 categories


def test_standardize_mean0_popstd1(spark):
    long = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate([1, 2, 4, 10])] +
                                 [(i, "c", 5.0) for i in range(4)], "id long, feature string, value double")
    s, _ = prep.standardize(long)
    st = {r.feature: r for r in s.groupBy("feature").agg(F.avg("value").alias("m"),
                                                         F.stddev_pop("value").alias("sd")).collect()}
    assert st["f"].m == pytest.approx(0.0, abs=1e-12) and st["f"].sd == pytest.approx(1.0)
    assert st["c"].sd == pytest.approx(0.0)  # constant column maps to 0


def test_skew_is_bias_corrected(spark):
    long = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate([1, 2, 4, 10])],
                                 "id long, feature string, value double")
    assert prep.skewness(long).first().skew == pytest.approx(1.469, abs=1e-3)


def test_yeo_johnson_mle_beats_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(0, 0.8, 300)
    long = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(x)], "id long, feature string, value double")
    fit = prep.fit_yeo_johnson(long).first()
    lam = fit["lambda"]

    def ll(l):
        y = np.where(x >= 0, (np.power(x + 1, l) - 1) / l if abs(l) > 1e-12 else np.log1p(x), 0)
        return -len(x) / 2 * math.log(np.var(y)) + (l - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
    assert ll(lam) >= ll(lam + 0.05) and ll(lam) >= ll(lam - 0.05)


def _three_groups(spark, n_per=(15, 20, 15), seed=42):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g, n in enumerate(n_per):
        for _ in range(n):
            rows.append((i, g, *(rng.normal(g * 10, 1.0, 3).tolist())))
            i += 1
    return spark.createDataFrame(rows, "id long, truth int, a double, b double, c double")


def test_kmeans_recovers_three_groups(spark):
    df = _three_groups(spark)
    vecs = cluster.scaled_vectors(df, "id", ["a", "b", "c"])
    table, assign = cluster.kmeans_search(vecs, (2, 5), 3)
    assert table.where("best").first().k == 3
    j = assign.join(df.select("id", "truth"), "id")
    pure = j.groupBy("cluster").agg(F.count_distinct("truth").alias("t")).collect()
    assert all(r.t == 1 for r in pure)


def test_label_metrics_ranges(spark):
    df = _three_groups(spark)
    long = prep.to_long(df, "id", ["a", "b", "c"])
    labels = df.select("id", F.col("truth").alias("cluster"))
    sil = metrics.silhouette_sq(long, labels, "id").first()[0]
    ch = metrics.calinski_harabasz(long, labels, "id").first()[0]
    db = metrics.davies_bouldin(long, labels, "id").first()[0]
    assert 0.9 < sil <= 1.0 and ch > 100 and 0 < db < 0.5
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        df.withColumn("cluster", F.col("truth").cast("double")))
    assert sil == pytest.approx(ClusteringEvaluator(predictionCol="cluster").evaluate(v), abs=1e-9)
    imp = {r.feature: r.importance for r in metrics.variance_ratio_importance(long, labels, "id").collect()}
    assert all(v > 10 for v in imp.values())


def test_morans_i_positive_for_blocks(spark):
    pts = [(i * 10 + j, float(i), float(j)) for i in range(6) for j in range(6)]
    labels = spark.createDataFrame([(p[0], 0 if p[1] < 3 else 1) for p in pts], "id long, cluster int")
    coords = spark.createDataFrame(pts, "pid long, x double, y double")
    from tessera.operators.neighbors import knn_join
    nn = knn_join(coords, coords.withColumnRenamed("pid", "tid"), 3, exclude_self=True)
    edges = nn.select(F.col("pid").alias("i"), F.col("tid").alias("j"))
    r = metrics.morans_i(labels, None, "id", edges.withColumnRenamed("i", "i")).first()
    assert r.morans_i > 0.5 and r.morans_i_pvalue < 0.05


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (80, 2)))]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    from tessera.operators.neighbors import knn_join
    got = {(r.pid, r.rank): r.tid for r in knn_join(df, df.withColumnRenamed("pid", "tid"), 3,
                                                     exclude_self=True).collect()}
    for i, x, y in pts:
        d = sorted((math.hypot(x - a, y - b), j) for j, a, b in pts if j != i)[:3]
        for k, (_, j) in enumerate(d, 1):
            assert got[(i, k)] == j


def test_persona_rules(spark):
    prof = spark.createDataFrame(
        [(0, "peak_hour_ratio", 0.5), (0, "member_ratio", 0.8), (0, "total_trips", 10000.0),
         (1, "member_ratio", 0.1), (1, "avg_trip_duration_minutes", 8.0), (1, "spending_pct_entertainment", 0.3)],
        "cluster int, feature string, mean double")
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "county_fips string, cluster int")
    t = {r.cluster: r.persona_type for r in personas.cluster_traits(prof, labels).collect()}
    assert t == {0: "Urban Commuter", 1: "Tourist Explorer"}
    v = spark.range(1).select(personas.market_value(F.lit(1000), F.lit("high"), F.lit("high")).alias("hi"),
                              personas.market_value(F.lit(1000), F.lit("low"), F.lit("low")).alias("lo")).first()
    assert v.hi > 500000 and v.lo < 200000
    top = spark.createDataFrame([(0, "a", 3.0), (0, "b", -2.5), (0, "c", 2.8), (1, "a", 0.5), (1, "b", -0.3),
                                 (1, "c", 0.2)], "cluster int, feature string, z_score double")
    eff = {r.cluster: r.targeting_effectiveness for r in personas.targeting_effectiveness(top).collect()}
    assert eff[0] > 0.8 and eff[1] < 0.5


def test_density_clusters_two_blobs(spark):
    from tessera.operators.density import density_clusters
    rng = np.random.default_rng(5)
    a = rng.normal([0, 0], 0.1, (20, 2))
    b = rng.normal([5, 5], 0.1, (20, 2))
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([a, b, [[20.0, -20.0]]]))]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    res = {r.pid: r.cluster for r in density_clusters(df, 5, 3).collect()}
    assert len({res[i] for i in range(20)}) == 1 and len({res[i] for i in range(20, 40)}) == 1
    assert res[0] != res[20] and res[0] >= 0 and res[20] >= 0
    assert res[40] == -1


def test_stream_equals_batch(spark):
    import uuid
    from tessera.streaming.windows import hourly_window_counts, run_hourly_stream, stream_paths
    src = "/root/testdata/sf0.001/events*.parquet"
    out, ck = stream_paths(spark, "test-" + uuid.uuid4().hex[:6])
    streamed = run_hourly_stream(spark, src, out, ck)
    batch = hourly_window_counts(spark.read.parquet(src))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_stream_keeps_rows_of_files_out_of_time_order(spark, tmp_path):
    """Part files read newest events first, windows over both: no row is late."""
    import datetime as dt
    import os
    import uuid
    from tessera.streaming.windows import run_hourly_stream, stream_paths
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=10 * k), "ab"[k % 2], float(k) if k % 5 else None) for k in range(144)]
    parts = [[r for k, r in enumerate(rows) if k // 36 == n or k % 7 == n] for n in (3, 2, 1, 0)]
    schema = "ts timestamp_ntz, event_type string, value double"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        file = next((tmp_path / f"w{n}").glob("part-*.parquet"))
        os.utime(file, (1_700_000_000 + 100 * n,) * 2)  # the stream reads by modification time
    out, ck = stream_paths(spark, "test-" + uuid.uuid4().hex[:6])
    got = {(r.window_start, r.event_type): (r.events, r.avg_value)
           for r in run_hourly_stream(spark, f"{tmp_path}/w*/*.parquet", out, ck).collect()}
    want: dict = {}
    for ts, kind, value in sum(parts, []):
        want.setdefault((ts.replace(minute=0), kind), []).append(value)
    assert {k: e for k, (e, _) in got.items()} == {k: len(v) for k, v in want.items()}
    for k, values in want.items():
        known = [v for v in values if v is not None]
        assert got[k][1] == (pytest.approx(sum(known) / len(known)) if known else None)


def test_grouped_quantiles_hot_group_and_global(spark):
    rng = np.random.default_rng(11)
    hot = rng.exponential(3.0, 3000)          # one group with many distinct values
    ties = np.repeat([1.0, 2.0, 2.0, 7.0], 50)  # heavy ties
    rows = [("hot", float(v)) for v in hot] + [("ties", float(v)) for v in ties] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    rows += [("hot", 1e12), ("hot", -1e12)]
    hot = np.concatenate([hot, [1e12, -1e12]])
    df = spark.createDataFrame(rows, "k string, v double")
    q = {r.k: r for r in grouped_quantiles(df, ["k"], "v", {"p10": 0.1, "med": 0.5, "p99": 0.99}).collect()}
    q1 = {r.k: r for r in grouped_quantiles(df, ["k"], "v", {"p10": 0.1, "med": 0.5, "p99": 0.99}).collect()}
    for name, p in (("p10", 0.1), ("med", 0.5), ("p99", 0.99)):
        assert q["hot"][name] == pytest.approx(np.quantile(hot, p))
        assert q["ties"][name] == pytest.approx(np.quantile(ties, p))
        assert q["one"][name] == pytest.approx(4.0)
        assert q1["hot"][name] == pytest.approx(q["hot"][name])
    g = grouped_quantiles(df, [], "v", {"med": 0.5}).first()
    assert g.med == pytest.approx(np.median(np.concatenate([hot, ties, [4.0]])))


def test_gbt_staged_loss_equals_separate_fit(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = x[:, 0] * 3 + np.sin(x[:, 1]) + rng.normal(0, 0.1, 200)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, "
                                                                                  "label double"))
    tr, te = df.limit(150), df.subtract(df.limit(150))
    big = GBTRegressor(maxIter=8, maxDepth=3, seed=42).fit(tr)
    small = GBTRegressor(maxIter=4, maxDepth=3, seed=42).fit(tr)
    staged = big.evaluateEachIteration(te, "squared")
    assert staged[3] == pytest.approx(RegressionEvaluator(metricName="mse").evaluate(small.transform(te)), rel=1e-12)


def test_compare_algorithms_best_flags(spark):
    rows = spark.createDataFrame([("kmeans", 2, 0, 0.4, None), ("density", 3, 2, 0.6, None)],
                                 "algorithm string, n_clusters int, n_outliers int, silhouette double, "
                                 "stability double")
    out = {r.algorithm: r for r in cluster.compare_algorithms(rows).collect()}
    assert out["density"].best_silhouette and not out["kmeans"].best_silhouette
    assert not out["density"].best_stability and not out["kmeans"].best_stability
