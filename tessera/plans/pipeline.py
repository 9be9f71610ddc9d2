"""The complete feature pipeline (skew → Yeo-Johnson → correlation
pruning → standardization → PCA composite indices), on the county table.

Each step is a Spark job over the long feature table; decisions that
change the schema (skewed columns, columns to drop, index groups) are
taken on the driver from per-feature result tables whose size is the
number of features.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import prep

# Fixed values that must equal the reference's results (name patterns of
# the three composite indices).
INDEX_GROUPS = {
    "mobility_index": ["trip", "mobility"],
    "spending_index": ["spending"],
    "temporal_index": ["hour", "weekend", "seasonal"],
}


def composite_indices(long: DataFrame, id_col: str, n_components: int = 2) -> tuple[DataFrame, DataFrame]:
    """Per index group (≥ 2 features) mean-impute, centre, Spark ML
    PCA (its transform does not centre); each component's sign is fixed
    so that its largest-magnitude loading is positive.  Returns (scores
    (id, index, component, value), explained variance table)."""
    spark = long.sparkSession
    feats = sorted(r[0] for r in long.select("feature").distinct().collect())
    scores, variances = None, []
    imputed = prep.mean_impute(long)
    for name, pats in INDEX_GROUPS.items():
        group = [f for f in feats if any(p in f.lower() for p in pats)]
        if len(group) < 2:
            continue
        k = min(n_components, len(group))
        wide = prep.to_wide(imputed.where(F.col("feature").isin(*group)), id_col, group)
        means = wide.agg(*[F.avg(c).alias(c) for c in group]).first()
        centred = wide.select(id_col, *[(F.col(c) - F.lit(means[c])).alias(c) for c in group])
        vec = VectorAssembler(inputCols=group, outputCol="x").transform(centred)
        model = PCA(k=k, inputCol="x", outputCol="pc").fit(vec)
        pcs = model.pc.toArray()
        signs = [1.0 if pcs[abs(pcs[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
        out = model.transform(vec).select(id_col, F.lit(name).alias("index"), F.posexplode(
            vector_to_array(F.col("pc"))).alias("component", "value"))
        sign_map = F.create_map(*[x for j, s in enumerate(signs) for x in (F.lit(j), F.lit(s))])
        out = out.withColumn("value", F.col("value") * F.element_at(sign_map, F.col("component")))
        out = out.withColumn("component", F.col("component") + 1)
        scores = out if scores is None else scores.unionByName(out)
        for j, v in enumerate(model.explainedVariance.toArray()):
            variances.append((name, j + 1, float(v), len(group)))
    var = spark.createDataFrame(variances, "index string, component int, explained_variance_ratio double, "
                                           "n_features int")
    if scores is None:
        scores = spark.createDataFrame([], f"{id_col} string, index string, component int, value double")
    return scores, var


def feature_pipeline(wide: DataFrame, id_col: str, features: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (final long features, composite-index scores, step log)."""
    spark = wide.sparkSession
    log = [("combined_features", len(features))]
    long = prep.to_long(wide, id_col, features)
    skewed = [r[0] for r in prep.skewness(long).where("skewed").select("feature").collect()]
    log.append(("skewed_features", len(skewed)))
    if skewed:
        lambdas = prep.fit_yeo_johnson(long.where(F.col("feature").isin(*skewed)))
        long = prep.apply_yeo_johnson(long, lambdas)
    t_wide = prep.to_wide(long, id_col, features)
    drop = [r[0] for r in prep.correlated_to_drop(prep.correlation_pairs(t_wide, features)).collect()]
    kept = [f for f in features if f not in drop]
    log.append(("after_correlation_removal", len(kept)))
    long = long.where(F.col("feature").isin(*kept))
    scaled, _ = prep.standardize(long)
    scores, _var = composite_indices(scaled, id_col)
    log.append(("final_features", len(kept) + scores.select("index", "component").distinct().count()))
    steps = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(log)], "step_order int, step string, count int")
    return scaled, scores, steps
