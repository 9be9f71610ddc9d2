"""Model-based clustering (K01, K07, K11, K13) with Spark ML.

Entities are rows of a wide feature table keyed by an id column.  All fits
of a K-Means search (k × seed) share their passes over the points
(``lloyd.py``); silhouettes are by squared Euclidean distance, matching
``metrics.silhouette_sq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.operators import lloyd
from tessera.operators.features import NIGHT_HOURS, PEAK_HOURS

STATION_FEATURES = [
    "starts", "avg_duration", "avg_distance", "avg_speed", "member_share", "inter_county_share",
    "peak_share", "weekend_share", "night_share", "summer_share",
]


def station_features(enriched_trips: DataFrame) -> DataFrame:
    """Ten usage features per start station: one grouped aggregate over
    trips (partial aggregation absorbs a station holding most trips)."""
    ts = F.col("start_time")
    share = lambda c: F.avg(c.cast("double"))
    return enriched_trips.groupBy(F.col("start_station_id").alias("station_id")).agg(
        F.count(F.lit(1)).cast("double").alias("starts"),
        F.avg("trip_duration_minutes").alias("avg_duration"),
        F.avg("trip_distance_km").alias("avg_distance"),
        F.coalesce(F.avg("trip_speed_kmh"), F.lit(0.0)).alias("avg_speed"),
        share(F.col("member_type") == "member").alias("member_share"),
        share(F.col("is_inter_county")).alias("inter_county_share"),
        share(F.hour(ts).isin(*PEAK_HOURS)).alias("peak_share"),
        share(F.weekday(ts).isin(5, 6)).alias("weekend_share"),
        share(F.hour(ts).isin(*NIGHT_HOURS)).alias("night_share"),
        share(temporal.season(F.month(ts)) == "Summer").alias("summer_share"),
    )


def scaled_columns(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(id, features) with each column standardized by its mean and
    population std (constant columns → 0), as the reference's scaler."""
    stats = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m_{i}") for i, f in enumerate(features)],
                   *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{i}") for i, f in enumerate(features)]).first()
    cols = []
    for i, f in enumerate(features):
        m, s = stats[f"m_{i}"] or 0.0, stats[f"s_{i}"] or 0.0
        x = F.coalesce(F.col(f).cast("double"), F.lit(m))
        cols.append(((x - m) / (s if s > 0 else 1.0)).alias(f))
    return df.select(id_col, *cols)


def scaled_vectors(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(id, features VECTOR) of ``scaled_columns``."""
    scaled = scaled_columns(df, id_col, features)
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(scaled).select(id_col, "features")


def kmeans_search(vecs: DataFrame, k_range=(2, 10), n_init: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """For each k the best of ``n_init`` seeded fits (min inertia),
    its silhouette; best k = max silhouette, smallest k on ties.  All fits
    run at once, one pass over the points an iteration (``lloyd.fitted``).

    Returns (search table (k, silhouette, inertia, best), assignments
    (id, cluster)).  k is capped at n - 1."""
    spark = vecs.sparkSession
    points = lloyd.as_points(vecs)
    n = points.count()
    ks = [k for k in range(k_range[0], k_range[1] + 1) if k <= n - 1]
    models = lloyd.fitted(points, [(k, seed + i) for k in ks for i in range(n_init)])
    best = [min((m for m in models if m.k == k), key=lambda m: (m.cost, m.seed)) for k in ks]
    rows = [(m.k, float(s), m.cost, m.seed) for m, s in zip(best, lloyd.silhouettes(points, best))]
    best_k = min(rows, key=lambda r: (-r[1], r[0]))[0] if rows else None
    table = spark.createDataFrame([(k, sil, cost, seed_, k == best_k) for k, sil, cost, seed_ in rows],
                                  "k int, silhouette double, inertia double, seed int, best boolean")
    if best_k is None:
        return table, spark.createDataFrame([], "id long, cluster int")
    return table, lloyd.assigned(vecs, best[ks.index(best_k)])


def stability(vecs: DataFrame, k: int, n_bootstrap: int = 10, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """Refit on bootstrap resamples (with replacement, seed 42 + i: each
    point counts as often as a Poisson variate of its hash says, whatever
    the partitioning), all rounds at once; statistic
    1 - popstd / max(mean, 1) of the counts of clusters that hold points."""
    models = lloyd.fitted(lloyd.as_points(vecs), [(k, seed + i) for i in range(n_bootstrap)], rate=frac)
    c = vecs.sparkSession.createDataFrame([(i, int((m.sizes > 0).sum())) for i, m in enumerate(models)], "round int, n_clusters int")
    return c.agg(F.avg("n_clusters").alias("mean_clusters"), F.stddev_pop("n_clusters").alias("std_clusters"),
                 F.count(F.lit(1)).alias("rounds")).withColumn(
        "stability_score", 1 - F.col("std_clusters") / F.greatest(F.col("mean_clusters"), F.lit(1.0)))


def classifier_importance(vecs: DataFrame, labels: DataFrame, id_col: str, features: Sequence[str],
                          seed: int = 42) -> DataFrame:
    """Random forest (100 trees) predicting the cluster label; Gini
    feature importances and training accuracy (noise removed).  The
    reference uses mean |SHAP|; the ranking here is Gini importance."""
    data = (vecs.join(labels.select(id_col, "cluster"), id_col).where(F.col("cluster") != -1)
            .withColumn("label", F.col("cluster").cast("double")))
    model = RandomForestClassifier(numTrees=100, seed=seed, featuresCol="features", labelCol="label").fit(data)
    acc = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label").evaluate(model.transform(data))
    imp = model.featureImportances.toArray().tolist()
    rows = [(f, float(v), float(acc)) for f, v in zip(features, imp)]
    out = vecs.sparkSession.createDataFrame(rows, "feature string, gini_importance double, accuracy double")
    w = Window.orderBy(F.desc("gini_importance"), F.asc("feature"))
    return out.withColumn("rank", F.row_number().over(w))


def compare_algorithms(results: DataFrame) -> DataFrame:
    """Per algorithm (n_clusters, n_outliers, silhouette, stability)
    plus the best algorithm on each measure (``max_by``)."""
    best_sil = results.select(F.max_by("algorithm", F.struct("silhouette", F.col("algorithm")))).scalar()
    best_stab = (results.where(F.col("stability").isNotNull())
                 .select(F.max_by("algorithm", F.struct("stability", F.col("algorithm")))).scalar())
    return results.withColumn("best_silhouette", F.col("algorithm") == best_sil) \
        .withColumn("best_stability", F.coalesce(F.col("algorithm") == best_stab, F.lit(False)))
