"""Registered queries: model-based clustering and spending prediction
(K01, K07, K11, K13, K14, R01-R09).  Model outputs are checked rows-only
by the driver (no SQL oracle), and by property tests in pytest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cluster as C
from tessera.operators import predict as R
from tessera.oracle.views import cte, with_
from tessera.plans import catalog_cluster as CC
from tessera.plans import catalog_features  # noqa: F401  (feature CTEs)
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import views

K01_RANGE = (2, 10)  # the reference's search range
N_INIT = 10


def station_vectors(spark, d):
    ctx = context(spark, d)
    feats = ctx._keep("station_features", lambda: C.station_features(ctx.enriched_trips()))
    return C.scaled_vectors(feats, "station_id", C.STATION_FEATURES)


def county_vectors(spark, d):
    return C.scaled_vectors(CC.county_features(spark, d), "county_fips", CC.CLUSTER_FEATURES)


@register("k01_kmeans_optimal_stations")
def k01(spark, d):
    """K-Means search over k = 2..10 (10 seeded fits each) on ten usage
    features of every start station."""
    table, _ = C.kmeans_search(station_vectors(spark, d), K01_RANGE, N_INIT)
    return table


@register("k01_kmeans_optimal_counties")
def k01c(spark, d):
    """K-Means search over k = 2..min(10, n-1) on the county matrix;
    returns the county assignments of the best k."""
    _, assign = C.kmeans_search(county_vectors(spark, d), (2, 10), N_INIT)
    return assign


@register("k07_stability_testing")
def k07(spark, d):
    vecs = county_vectors(spark, d)
    table, _ = C.kmeans_search(vecs, (2, 10), N_INIT)
    best = table.where("best").select("k").first()
    return C.stability(vecs, int(best[0]) if best else 2, 10, 0.8)


@register("k11_classifier_importance")
def k11(spark, d):
    return C.classifier_importance(county_vectors(spark, d), views.assignments(spark, d), "county_fips",
                                   CC.CLUSTER_FEATURES)


@register("k13_compare_algorithms")
def k13(spark, d, with_stability: bool = True):
    """K-Means (best k), density clustering and the fixed label table on
    the county matrix: clusters, outliers, squared-Euclidean silhouette
    (noise removed) and bootstrap stability per algorithm (none for fixed
    labels), best flags."""
    from tessera.operators import metrics
    from tessera.operators.density import density_stability
    long = CC.cluster_matrix(spark, d)
    vecs = county_vectors(spark, d)
    km = county_kmeans_labels(spark, d)
    stable = {}
    if with_stability:
        k = km.select(F.count_distinct("cluster")).first()[0]
        stable = {"kmeans": float(C.stability(vecs, k, 10, 0.8).first()["stability_score"]),
                  "density": density_stability(county_pc_plane(spark, d), 5, 3)}
    rows = None
    dens = county_density_labels(spark, d).select("county_fips", "cluster")
    for name, lab in (("kmeans", km), ("density", dens), ("fixed_labels", views.assignments(spark, d))):
        sil = metrics.silhouette_sq(long, lab, "county_fips").select("silhouette_sq_euclidean").first()[0]
        r = lab.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
                    F.count_if(F.col("cluster") == -1).alias("n_outliers")).select(
            F.lit(name).alias("algorithm"), "n_clusters", "n_outliers",
            F.lit(float(sil)).alias("silhouette"), F.lit(stable.get(name)).cast("double").alias("stability"))
        rows = r if rows is None else rows.unionByName(r)
    return C.compare_algorithms(rows)


# ------------------------------------------------------------ prediction
cte("prediction_data", """
SELECT l.county_fips, l.date, l.spending_amount, CAST(l.year AS BIGINT) AS year, CAST(l.month AS BIGINT) AS month,
       l.quarter, l.season, l.spending_lag_1, l.spending_lag_3, l.spending_ma_3, m.total_trips, m.member_ratio
FROM county_mobility m JOIN spend_lags l ON m.county_fips = l.county_fips""", ("county_mobility", "spend_lags"))


def _prediction_data(spark, d):
    ctx = context(spark, d)
    mob = ctx.county_mobility().select("county_fips", "total_trips", "member_ratio")
    return ctx._keep("prediction_data", lambda: R.prepare_prediction_data(mob, ctx.spending()))


@register("r01_prepare_prediction_data", with_("prediction_data") + "SELECT * FROM prediction_data",
          (("spending_amount", 4), ("spending_lag_1", 4), ("spending_lag_3", 4), ("spending_ma_3", 4),
           "member_ratio"))
def r01(spark, d):
    return _prediction_data(spark, d)


@register("r02_time_series_split", with_("prediction_data") + """
SELECT county_fips, date, CAST(rn AS BIGINT) AS row_index,
       CAST(CASE WHEN rn >= n - 3 * ts THEN (rn - (n - 3 * ts)) // ts ELSE -1 END AS BIGINT) AS test_fold
FROM (SELECT county_fips, date, row_number() OVER (ORDER BY date, county_fips) - 1 AS rn,
             count(*) OVER () AS n, count(*) OVER () // 4 AS ts FROM prediction_data) AS x""")
def r02(spark, d):
    return R.time_series_folds(_prediction_data(spark, d), 3).select("county_fips", "date", "row_index", "test_fold")


@register("r03_train_random_forest")
def r03(spark, d):
    """Random forest over the reference's 27-point grid, time-series CV."""
    return R.train_spending_predictor(_prediction_data(spark, d), "random_forest")["metrics"]


@register("r04_train_gradient_boosting")
def r04(spark, d):
    """Gradient-boosted trees (stands in for XGBoost) over its 27-point grid."""
    return R.train_spending_predictor(_prediction_data(spark, d), "gbt")["metrics"]


@register("r07_feature_importance")
def r07(spark, d):
    return R.train_spending_predictor(_prediction_data(spark, d), "random_forest")["importance"]


@register("r08_predict_future_spending")
def r08(spark, d):
    res = R.train_spending_predictor(_prediction_data(spark, d), "random_forest")
    return R.predict_spending(res["model"], _prediction_data(spark, d))


@register("r08_forecast_periods_boosted")
def r08_boosted(spark, d):
    """Six months after each county's last one by the boosted model, each prediction feeding the next."""
    data = _prediction_data(spark, d)
    return R.forecast_spending(R.train_spending_predictor(data, "gbt")["model"], data, 6)


# weights of the forecast that SQL can follow
FORECAST_WEIGHTS = {"spending_lag_1": 0.5, "spending_lag_3": 0.2, "spending_ma_3": 0.25, "total_trips": 0.01}


def _forecast_sql(periods: int) -> str:
    """The recursion written out, one step a period."""
    w = FORECAST_WEIGHTS
    steps = [with_("prediction_data").rstrip() + """,
f0 AS (SELECT county_fips, max(CASE WHEN age = 1 THEN date END) AS date, max(CASE WHEN age = 1 THEN total_trips END) AS trips,
  max(CASE WHEN age = 1 THEN spending_amount END) AS a1, max(CASE WHEN age = 2 THEN spending_amount END) AS a2,
  max(CASE WHEN age = 3 THEN spending_amount END) AS a3
  FROM (SELECT *, row_number() OVER (PARTITION BY county_fips ORDER BY date DESC) AS age FROM prediction_data) AS p
  WHERE age <= 3 GROUP BY county_fips)"""]
    for i in range(1, periods + 1):
        steps.append(f"""f{i} AS (SELECT county_fips, date + INTERVAL 1 MONTH AS date, trips,
  {w['spending_lag_1']} * coalesce(a1, 0) + {w['spending_lag_3']} * coalesce(a3, 0)
  + {w['spending_ma_3']} * coalesce((a1 + a2 + a3) / 3, 0) + {w['total_trips']} * trips AS a1, a1 AS a2, a2 AS a3
  FROM f{i - 1})""")
    return ",\n".join(steps) + "\n" + "\nUNION ALL ".join(
        f"SELECT county_fips, CAST({i} AS BIGINT) AS period, date, a1 AS predicted_spending FROM f{i}" for i in range(1, periods + 1))


@register("r08_forecast_periods_linear", _forecast_sql(6), (("predicted_spending", 2),))
def r08_linear(spark, d):
    """Six months ahead by a linear model with given weights."""
    return R.forecast_spending(R.LinearModel(FORECAST_WEIGHTS), _prediction_data(spark, d), 6)


@register("r09_boosted_prediction_drivers")
def r09_boosted(spark, d):
    """Importance of the boosted model by driver group."""
    res = R.train_spending_predictor(_prediction_data(spark, d), "gbt")
    return R.prediction_drivers(res["importance"])


@register("r09_prediction_drivers")
def r09(spark, d):
    res = R.train_spending_predictor(_prediction_data(spark, d), "random_forest")
    return R.prediction_drivers(res["importance"])


@register("k02_density_clustering_stations")
def k02(spark, d):
    """Hierarchical density clustering of station locations
    (min_cluster_size 5, min_samples 3): cluster, membership and outlier
    score per station."""
    from tessera.operators.hierarchy import hierarchical_clusters
    st = context(spark, d).stations().select(F.col("station_id").alias("pid"), F.col("lng").alias("x"),
                                              F.col("lat").alias("y"))
    return hierarchical_clusters(st, ["x", "y"], 5, 3).withColumnRenamed("pid", "station_id")


@register("k06_density_tuning_stations")
def k06(spark, d):
    """The reference's 27-point tuning grid for density clustering of
    station locations."""
    from tessera.operators.density import tune_density
    st = context(spark, d).stations().select(F.col("station_id").alias("pid"), F.col("lng").alias("x"),
                                              F.col("lat").alias("y"))
    return tune_density(st)


FITTED = {"kmeans": lambda spark, d: county_kmeans_labels(spark, d),
          "density": lambda spark, d: county_density_labels(spark, d).select("county_fips", "cluster")}


def analysis_of(spark, d, labels):
    """K14 for one clustering of the counties: (section, cluster, feature, measure, value)."""
    from tessera.operators import metrics
    long, raw = CC.cluster_matrix(spark, d), CC.raw_long(spark, d)
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def rows(df, section, measures, cluster=none, feature=text):
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        return df.select(F.lit(section).alias("section"), cluster.alias("cluster"), feature.alias("feature"), pairs.alias("m")).select(
            "section", "cluster", "feature", "m.measure", "m.value")

    counts = labels.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
                        F.count_if(F.col("cluster") == -1).alias("n_outliers"), F.count(F.lit(1)).alias("n_samples"))
    profiles = metrics.cluster_profiles(raw, labels, "county_fips")
    geographic = metrics.morans_i(labels, None, "county_fips", CC.county_knn_edges(spark, d))
    outliers = metrics.outlier_analysis(long, labels, "county_fips")
    own = ["outlier_mean", "outlier_std", "overall_mean", "z_score"]
    parts = [
        rows(counts, "size", ["n_samples", "n_clusters", "n_outliers"]),
        rows(metrics.silhouette_sq(long, labels, "county_fips"), "internal", ["silhouette_sq_euclidean"]),
        rows(metrics.calinski_harabasz(long, labels, "county_fips"), "internal", ["calinski_harabasz"]),
        rows(metrics.davies_bouldin(long, labels, "county_fips"), "internal", ["davies_bouldin"]),
        rows(geographic, "geographic", ["morans_i", "morans_i_zscore"]),
        rows(profiles, "profile", ["mean", "median", "std", "min", "max", "count"], F.col("cluster").cast("int"), F.col("feature")),
        rows(metrics.variance_ratio_importance(long, labels, "county_fips"), "importance", ["importance"], feature=F.col("feature")),
        rows(outliers, "outliers", own, feature=F.col("feature"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("k14_complete_clustering_analysis")
def k14(spark, d):
    """The whole analysis of both algorithms on the county matrix, one
    measure a row: sizes, internal and geographic validation, stability of
    K-Means, cluster profiles, feature importance, outlier features.  An
    algorithm that fails is one row with its error, not an exception."""
    from tessera.session import cut_lineage
    whole = None
    for name, fit in FITTED.items():
        try:
            labels = fit(spark, d)
            part = analysis_of(spark, d, labels).withColumn("error", F.lit(None).cast("string"))
            if name == "kmeans":
                k = labels.select(F.count_distinct("cluster")).first()[0]
                score = C.stability(county_vectors(spark, d), k, 10, 0.8).select(
                    F.lit("stability").alias("section"), F.lit(None).cast("int").alias("cluster"),
                    F.lit(None).cast("string").alias("feature"), F.lit("stability_score").alias("measure"),
                    F.col("stability_score").alias("value"), F.lit(None).cast("string").alias("error"))
                part = part.unionByName(score)
            part = cut_lineage(part.withColumn("algorithm", F.lit(name)))
        except Exception as e:  # noqa: BLE001 - reported as a row
            part = spark.createDataFrame([("status", None, None, "failed", None, str(e)[:500], name)],
                                         "section string, cluster int, feature string, measure string, value double, "
                                         "error string, algorithm string")
        whole = part if whole is None else whole.unionByName(part)
    return whole.select("algorithm", "section", "cluster", "feature", "measure", "value", "error")


def county_pc_plane(spark, d):
    """Counties in the plane of the first two principal components of the
    scaled feature matrix (centred; Spark ML PCA)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    vecs = county_vectors(spark, d)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vecs)
    arr = vector_to_array(F.col("pc"))
    return model.transform(vecs).select(F.col("county_fips").cast("long").alias("pid"),
                                        arr[0].alias("x"), arr[1].alias("y"))


def county_density_labels(spark, d):
    """Hierarchical density clustering of the counties on the whole scaled feature matrix."""
    from tessera.operators.hierarchy import hierarchical_clusters

    def build():
        wide = C.scaled_columns(CC.county_features(spark, d), "county_fips", CC.CLUSTER_FEATURES)
        return hierarchical_clusters(wide.withColumnRenamed("county_fips", "pid"), CC.CLUSTER_FEATURES, 5, 3)
    return context(spark, d)._keep("county_density_labels", build).withColumnRenamed("pid", "county_fips")


def county_kmeans_labels(spark, d):
    """The counties' clusters of the best K-Means over k = 2..10."""
    return context(spark, d)._keep(
        "county_kmeans_labels", lambda: C.kmeans_search(county_vectors(spark, d), (2, 10), N_INIT)[1])


@register("k02_density_clustering_counties")
def k02c(spark, d):
    """Hierarchical density clustering of counties on the whole scaled
    feature matrix (min_cluster_size 5, min_samples 3)."""
    return county_density_labels(spark, d)
