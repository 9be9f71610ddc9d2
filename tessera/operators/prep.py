"""Feature preparation (P01-P09, H12) on entity tables.

Feature matrices are handled in long form ``(entity, feature, value)``:
every per-feature statistic is then one grouped aggregate keyed by
feature, whatever the number of entities, and results join back on the
feature key.  Decisions that change the schema (which columns to drop)
are taken on the driver from small per-feature result tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import grouped_quantiles, skew_adjusted
from tessera.session import cut_lineage


def to_long(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """Wide → (id, feature, value DOUBLE)."""
    cast = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features])
    return cast.unpivot(id_col, list(features), "feature", "value")


def to_wide(long: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(id, feature, value) → wide, with an explicit feature list."""
    return long.groupBy(id_col).pivot("feature", list(features)).agg(F.first("value"))


def median_impute(long: DataFrame) -> DataFrame:
    """P08 step 1: nulls → the feature's exact median."""
    med = grouped_quantiles(long, ["feature"], "value", {"_med": 0.5})
    return (long.join(F.broadcast(med), "feature", "left")
            .withColumn("value", F.coalesce(F.col("value"), F.col("_med"))).drop("_med"))


def mean_impute(long: DataFrame) -> DataFrame:
    """Nulls → the feature mean."""
    m = long.groupBy("feature").agg(F.avg("value").alias("_m"))
    return (long.join(F.broadcast(m), "feature", "left")
            .withColumn("value", F.coalesce(F.col("value"), F.col("_m"))).drop("_m"))


def zero_variance_features(long: DataFrame) -> DataFrame:
    """P08 step 2: features whose sample variance is 0 (or undefined)."""
    v = long.groupBy("feature").agg(F.var_samp("value").alias("var"))
    return v.where(F.coalesce(F.col("var"), F.lit(0.0)) == 0).select("feature")


def prepare_clustering_data(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """Median-impute, then drop zero-variance features (long form)."""
    long = median_impute(to_long(df, id_col, features))
    return long.join(F.broadcast(zero_variance_features(long)), "feature", "left_anti")


def standardize(long: DataFrame, params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(x - mean) / population std; a constant feature maps to 0.

    ``params`` (feature, mean, scale) re-applies a fitted scaler; returns
    (scaled long table, params)."""
    if params is None:
        params = long.groupBy("feature").agg(
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        params = params.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))
    scaled = (long.join(F.broadcast(params.select("feature", "mean", "scale")), "feature")
              .withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale"))
              .drop("mean", "scale"))
    return scaled, params


def normalize(long: DataFrame, method: str = "standard") -> tuple[DataFrame, DataFrame]:
    """Standard (std n-1), minmax, robust (median / MAD); returns the
    parameter table (feature, method, a, b) with x' = (x - a) / b."""
    if method == "standard":
        p = long.groupBy("feature").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("b"))
    elif method == "minmax":
        p = long.groupBy("feature").agg(F.min("value").alias("a"),
                                        (F.max("value") - F.min("value")).alias("b"))
    elif method == "robust":
        # One row per feature; cut so the MAD pass plans on a small scan.
        med = cut_lineage(grouped_quantiles(long, ["feature"], "value", {"a": 0.5}))
        dev = (long.join(F.broadcast(med), "feature")
               .withColumn("dev", F.abs(F.col("value") - F.col("a"))))
        mad = grouped_quantiles(dev, ["feature"], "dev", {"b": 0.5})
        p = med.join(mad, "feature")
    else:
        raise ValueError(f"unknown method {method!r}")
    p = p.withColumn("method", F.lit(method))
    out = (long.join(F.broadcast(p), "feature")
           .withColumn("value", F.try_divide(F.col("value") - F.col("a"), F.col("b")))
           .drop("a", "b", "method"))
    return out, p


def skewness(long: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Bias-corrected skewness per feature and the |skew| > t flag."""
    s = long.groupBy("feature").agg(skew_adjusted("value").alias("skew"))
    return s.withColumn("skewed", F.coalesce(F.abs(F.col("skew")) > threshold, F.lit(False)))


def log_transform(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features with a value ≤ 0 get log1p(x + |min| + 1); features
    without one are left unchanged (as the reference does)."""
    p = long.groupBy("feature").agg(F.min("value").alias("min"))
    p = p.withColumn("shift", F.when(F.col("min") <= 0, F.abs(F.col("min")) + 1))
    out = (long.join(F.broadcast(p), "feature")
           .withColumn("value", F.when(F.col("shift").isNotNull(), F.log1p(F.col("value") + F.col("shift")))
                       .otherwise(F.col("value")))
           .drop("min", "shift"))
    return out, p.select("feature", "shift")


def yeo_johnson(x, lam):
    """Yeo-Johnson transform of column ``x`` for column ``lam``."""
    pos = x >= 0
    return (F.when(pos & (F.abs(lam) > 1e-12), (F.pow(x + 1, lam) - 1) / lam)
            .when(pos, F.log1p(x))
            .when(F.abs(lam - 2) > 1e-12, -(F.pow(-x + 1, F.lit(2.0) - lam) - 1) / (F.lit(2.0) - lam))
            .otherwise(-F.log1p(-x)))


def box_cox(x, lam):
    """Box-Cox transform of a positive column ``x`` for column ``lam``."""
    return F.when(F.abs(lam) > 1e-12, (F.pow(x, lam) - 1) / lam).otherwise(F.log(x))


def _loglik(long: DataFrame, grid: DataFrame, transform, log_slope) -> DataFrame:
    """Profile log-likelihood per (feature, lambda) in one aggregate."""
    j = long.join(grid, "feature")
    y = transform(F.col("value"), F.col("lam"))
    return j.groupBy("feature", "lam").agg(
        F.count("value").alias("n"), F.var_pop(y).alias("var"), F.sum(log_slope(F.col("value"))).alias("sl"),
    ).withColumn("ll", -F.col("n") / 2.0 * F.log(F.col("var")) + (F.col("lam") - 1) * F.col("sl"))


def _fit_lambda(long: DataFrame, transform, log_slope, lo: float, hi: float, rounds: int, steps: int) -> DataFrame:
    """Maximum-likelihood λ per feature, returned as (feature, lambda, loglik).

    A λ grid is exploded per feature and the log-likelihood of every λ comes from one aggregate.  While the optimum of
    a feature lies on the edge of its grid, the grid moves on to it; then ``rounds`` finer grids close in on it.
    λ whose transform leaves the range of a double have no finite variance and are passed over.
    """
    step = (hi - lo) / (steps - 1)
    centre = long.select("feature").distinct().withColumn("c", F.lit((lo + hi) / 2.0))
    best, closing = None, 0
    while closing < rounds:
        half = step * (steps - 1) / 2.0
        grid = (centre.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
                .select("feature", "c", (F.col("c") - half + F.col("i") * step).alias("lam")))
        ll = _loglik(long, F.broadcast(grid.select("feature", "lam")), transform, log_slope).where(
            (F.col("var") > 0) & (F.col("var") < 1e300) & ~F.isnan("ll"))
        best = cut_lineage(ll.groupBy("feature").agg(
            F.max_by("lam", F.col("ll")).alias("lambda"), F.max("ll").alias("loglik"),
            F.min("lam").alias("least"), F.max("lam").alias("most")))
        # on the edge of the whole grid, not only of the λ that have a likelihood
        moved = best.join(centre, "feature")
        edge = moved.where((F.abs(F.col("lambda") - F.col("c")) > half - step / 2)).count()
        centre = best.select("feature", F.col("lambda").alias("c"))
        if closing == 0 and edge:
            continue
        closing += 1
        step = 2 * step / (steps - 1)
    return best.select("feature", "lambda", "loglik")


def fit_yeo_johnson(long: DataFrame, lo: float = -3.0, hi: float = 3.0, rounds: int = 3,
                    steps: int = 61) -> DataFrame:
    """Maximum-likelihood Yeo-Johnson λ per feature (not standardized)."""
    return _fit_lambda(long, yeo_johnson, lambda x: F.signum(x) * F.log1p(F.abs(x)), lo, hi, rounds, steps)


def fit_box_cox(long: DataFrame, lo: float = -3.0, hi: float = 3.0, rounds: int = 3, steps: int = 61) -> DataFrame:
    """Maximum-likelihood Box-Cox λ of the features that are positive throughout."""
    positive = long.groupBy("feature").agg(F.min("value").alias("_least")).where("_least > 0").select("feature")
    return _fit_lambda(long.join(positive, "feature", "left_semi"), box_cox, F.log, lo, hi, rounds, steps)


def apply_yeo_johnson(long: DataFrame, lambdas: DataFrame) -> DataFrame:
    j = long.join(F.broadcast(lambdas.select("feature", "lambda")), "feature", "left")
    return j.withColumn("value", F.when(F.col("lambda").isNotNull(), yeo_johnson(F.col("value"), F.col("lambda")))
                        .otherwise(F.col("value"))).drop("lambda")


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered feature pair, long form
    (feature_i, feature_j, corr).  Centred sums in one aggregate pass after
    a means pass; a constant feature gives NULL (Spark's ``corr`` raises
    under ANSI, the reference's pandas gives NaN)."""
    feats = list(features)
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first()
    c = {f: F.col(f).cast("double") - F.lit(means[f]) if means[f] is not None else F.lit(None).cast("double")
         for f in feats}
    aggs = []
    for i, a in enumerate(feats):
        for b in feats[i:]:
            both = c[a].isNotNull() & c[b].isNotNull()
            aggs.append(F.sum(F.when(both, c[a] * c[b])).alias(f"xy_{i}_{feats.index(b)}"))
            aggs.append(F.sum(F.when(both, c[a] * c[a])).alias(f"xx_{i}_{feats.index(b)}"))
            aggs.append(F.sum(F.when(both, c[b] * c[b])).alias(f"yy_{i}_{feats.index(b)}"))
    row = df.agg(*aggs)
    structs = []
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            p, q = (i, j) if i <= j else (j, i)
            r = F.try_divide(F.col(f"xy_{p}_{q}"), F.sqrt(F.col(f"xx_{p}_{q}") * F.col(f"yy_{p}_{q}")))
            structs.append(F.struct(F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"),
                                    F.lit(i).alias("pos_i"), F.lit(j).alias("pos_j"), r.alias("corr")))
    return row.select(F.inline(F.array(*structs)))


def correlated_to_drop(corr: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Drop feature j if any earlier feature i (by position, dropped
    or not) has |corr| > threshold; NULL/NaN never drops."""
    return (corr.where((F.col("pos_i") < F.col("pos_j"))
                       & F.coalesce(F.abs(F.col("corr")) > threshold, F.lit(False)))
            .select(F.col("feature_j").alias("feature"), "pos_j").distinct())
