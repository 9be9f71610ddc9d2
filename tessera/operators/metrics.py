"""Cluster validation and profiling metrics driven by a label table
(K03-K05, K08-K10, K12).

Inputs: a long feature table ``(entity, feature, value)`` and labels
``(entity, cluster)``, joined **by key** (the reference aligns arrays by
position).  Every metric is a few grouped aggregates over entities or
(entity, cluster) pairs — O(n·k), never O(n²):

* silhouette uses squared Euclidean dissimilarity, computed from per-
  cluster sufficient statistics (the definition of Spark ML's
  ``ClusteringEvaluator``); the Euclidean form needs every pair of
  points and is not built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import grouped_quantiles

NOISE = -1


def _labelled(long: DataFrame, labels: DataFrame, id_col: str, drop_noise: bool = True) -> DataFrame:
    j = long.join(labels.select(id_col, "cluster"), id_col)
    return j.where(F.col("cluster") != NOISE) if drop_noise else j


def _nk(df: DataFrame, id_col: str) -> tuple[Column, Column]:
    """Scalar subqueries: (n points, k clusters) of the labelled entities."""
    return (df.select(F.count_distinct(id_col)).scalar(),
            df.select(F.count_distinct("cluster")).scalar())


def silhouette_sq(long: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Mean silhouette with squared Euclidean dissimilarity; -1 unless
    1 < k < n; singleton clusters score 0."""
    x = _labelled(long, labels, id_col).persist()
    cstat = x.groupBy("cluster", "feature").agg(F.sum("value").alias("sy"), F.sum(F.col("value") ** 2).alias("syy"))
    csize = x.groupBy("cluster").agg(F.count_distinct(id_col).alias("nc"))
    norms = x.groupBy(id_col, "cluster").agg(F.sum(F.col("value") ** 2).alias("xx"))
    # mean_y ||x - y||^2 = xx + Σ_f syy/nc - 2 Σ_f x_f sy_f / nc, for every (point, cluster).
    cross = (x.select(id_col, "feature", "value", F.col("cluster").alias("own"))
             .join(F.broadcast(cstat), "feature")
             .groupBy(id_col, "own", "cluster")
             .agg(F.sum(F.col("value") * F.col("sy")).alias("xs"), F.sum("syy").alias("syy")))
    d = (cross.join(F.broadcast(csize), "cluster")
         .join(norms.select(id_col, "xx"), id_col)
         .withColumn("dis", F.col("xx") + (F.col("syy") - 2 * F.col("xs")) / F.col("nc")))
    per = d.groupBy(id_col, "own").agg(
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("dis") * F.col("nc")
                     / F.when(F.col("nc") > 1, F.col("nc") - 1))).alias("a"),
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("nc"))).alias("own_n"),
        F.min(F.when(F.col("cluster") != F.col("own"), F.col("dis"))).alias("b"))
    s = (F.when(F.col("own_n") <= 1, F.lit(0.0))
         .when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b"))
         .when(F.col("a") > F.col("b"), F.col("b") / F.col("a") - 1).otherwise(F.lit(0.0)))
    n, k = _nk(x, id_col)
    score = per.agg(F.avg(s).alias("s"))
    return score.select(
        F.when((k > 1) & (k < n), F.col("s")).otherwise(F.lit(-1.0)).alias("silhouette_sq_euclidean"),
        n.alias("n"), k.alias("k"))


def calinski_harabasz(long: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(B / (k-1)) / (W / (n-k)); -1 when k ≤ 1."""
    x = _labelled(long, labels, id_col)
    overall = x.groupBy("feature").agg(F.avg("value").alias("mu"))
    cm = x.groupBy("cluster", "feature").agg(F.avg("value").alias("mc"), F.count("value").alias("nc"))
    b = (cm.join(F.broadcast(overall), "feature")
         .agg(F.sum(F.col("nc") * (F.col("mc") - F.col("mu")) ** 2).alias("B")))
    w = (x.join(F.broadcast(cm), ["cluster", "feature"])
         .select(F.sum((F.col("value") - F.col("mc")) ** 2)).scalar())
    n, k = _nk(x, id_col)
    return b.select(
        F.when(k > 1, F.try_divide(F.col("B") / (k - 1), w / (n - k))).otherwise(F.lit(-1.0))
        .alias("calinski_harabasz"), n.alias("n"), k.alias("k"))


def davies_bouldin(long: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Mean over clusters i of max_j (s_i + s_j) / d_ij; -1 when k ≤ 1.

    The j-loop joins the k centroids with each other: k² rows, bounded by
    the number of clusters, independent of the number of points."""
    x = _labelled(long, labels, id_col)
    cm = x.groupBy("cluster", "feature").agg(F.avg("value").alias("mc"))
    dist = (x.join(F.broadcast(cm), ["cluster", "feature"])
            .groupBy(id_col, "cluster").agg(F.sqrt(F.sum((F.col("value") - F.col("mc")) ** 2)).alias("d")))
    spread = dist.groupBy("cluster").agg(F.avg("d").alias("s"))
    a = cm.select(F.col("cluster").alias("ci"), "feature", F.col("mc").alias("mi"))
    b = cm.select(F.col("cluster").alias("cj"), "feature", F.col("mc").alias("mj"))
    dij = (a.join(b, "feature").where(F.col("ci") != F.col("cj"))
           .groupBy("ci", "cj").agg(F.sqrt(F.sum((F.col("mi") - F.col("mj")) ** 2)).alias("dij")))
    r = (dij.join(spread.select(F.col("cluster").alias("ci"), F.col("s").alias("si")), "ci")
         .join(spread.select(F.col("cluster").alias("cj"), F.col("s").alias("sj")), "cj")
         .withColumn("r", F.try_divide(F.col("si") + F.col("sj"), F.col("dij"))))
    per = r.groupBy("ci").agg(F.max("r").alias("rmax"))
    n, k = _nk(x, id_col)
    return per.agg(F.avg("rmax").alias("db")).select(
        F.when(k > 1, F.col("db")).otherwise(F.lit(-1.0)).alias("davies_bouldin"), n.alias("n"), k.alias("k"))


def erf(x: Column) -> Column:
    """Abramowitz-Stegun 7.1.26 (|error| < 1.5e-7)."""
    # Fixed coefficients of the published approximation.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    ax = F.abs(x)
    t = 1.0 / (1.0 + p * ax)
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    y = 1.0 - poly * F.exp(-ax * ax)
    return F.signum(x) * y


def morans_i(labels: DataFrame, coords: DataFrame, id_col: str, knn_edges: DataFrame) -> DataFrame:
    """Moran's I of numeric labels (noise → max + 1) on row-standardized
    kNN weights; normal-approximation z and two-sided p.

    ``knn_edges`` is (i, j) for each entity's k nearest neighbours (J08)."""
    mx = labels.where(F.col("cluster") != NOISE).select(F.max("cluster")).scalar()
    y = labels.select(F.col(id_col).alias("i"),
                      F.when(F.col("cluster") == NOISE, mx + 1).otherwise(F.col("cluster")).cast("double").alias("y"))
    n = y.select(F.count(F.lit(1)).cast("double")).scalar()
    _ = coords
    ybar = y.select(F.avg("y")).scalar()
    z = y.withColumn("z", F.col("y") - ybar)
    deg = knn_edges.groupBy("i").agg(F.count(F.lit(1)).alias("k"))
    w = knn_edges.join(deg, "i").withColumn("w", 1.0 / F.col("k")).select("i", "j", "w")
    zi = z.select("i", F.col("z").alias("zi"))
    zj = z.select(F.col("i").alias("j"), F.col("z").alias("zj"))
    num = w.join(zi, "i").join(zj, "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"))
    den = z.select(F.sum(F.col("z") ** 2)).scalar()
    rev = w.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("wr"))
    both = w.join(rev, ["i", "j"], "full").na.fill(0.0, ["w", "wr"])
    s0 = w.select(F.sum("w")).scalar()
    s1 = both.select(0.5 * F.sum((F.col("w") + F.col("wr")) ** 2)).scalar()
    out_deg = w.groupBy("i").agg(F.sum("w").alias("o"))
    in_deg = w.groupBy(F.col("j").alias("i")).agg(F.sum("w").alias("in_"))
    s2 = (out_deg.join(in_deg, "i", "full").na.fill(0.0, ["o", "in_"])
          .select(F.sum((F.col("o") + F.col("in_")) ** 2)).scalar())
    r = num
    ei = -1.0 / (n - 1)
    i_stat = n / s0 * F.col("num") / den
    v = ((n * n * s1 - n * s2 + 3 * s0 ** 2) / ((n * n - 1) * s0 ** 2) - ei * ei)
    zn = (i_stat - ei) / F.sqrt(v)
    pn = 2 * (1 - 0.5 * (1 + erf(F.abs(zn) / F.sqrt(F.lit(2.0)))))
    return r.select(
        i_stat.alias("morans_i"), zn.alias("morans_i_zscore"), pn.alias("morans_i_pvalue"),
        F.when(i_stat > 0, "positive").when(i_stat < 0, "negative").otherwise("none").alias("spatial_autocorrelation"),
        F.when(pn < 0.05, "significant").otherwise("not_significant").alias("spatial_significance"))


def cluster_profiles(long: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Per cluster × feature mean, median, std (n-1), min, max, count,
    and z of the cluster mean against the overall mean / std (n-1)."""
    x = _labelled(long, labels, id_col, drop_noise=False)
    stats = x.groupBy("cluster", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("count"))
    med = grouped_quantiles(x, ["cluster", "feature"], "value", {"median": 0.5})
    overall = x.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    return (stats.join(med, ["cluster", "feature"], "left").join(F.broadcast(overall), "feature")
            .withColumn("z_score", F.try_divide(F.col("mean") - F.col("mu"), F.col("sd")))
            .drop("mu", "sd"))


def distinguishing_features(profiles: DataFrame, top: int = 5) -> DataFrame:
    """Top features per cluster by |z| (ties by feature name)."""
    w = Window.partitionBy("cluster").orderBy(F.desc(F.abs(F.col("z_score"))), F.asc("feature"))
    return (profiles.where(F.col("z_score").isNotNull())
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("cluster", "feature", "z_score", "rank"))


def cluster_summary(labels: DataFrame, id_col: str) -> DataFrame:
    """K09 summary: size of each cluster and its members, a row for each (a cluster may hold most of all ids)."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return labels.select("cluster", F.col(id_col).cast("string").alias("member")).join(sizes, "cluster")


def variance_ratio_importance(long: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(total var - within var) / (within var + 1e-10), population
    variances, noise removed, singleton clusters left out of the within
    term; 0 when the overall variance is 0 or no cluster has 2+ members."""
    x = _labelled(long, labels, id_col)
    tot = x.groupBy("feature").agg(F.var_pop("value").alias("tv"))
    per = x.groupBy("feature", "cluster").agg(F.var_pop("value").alias("v"), F.count("value").alias("m"))
    within = (per.where(F.col("m") > 1).groupBy("feature")
              .agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("wv")))
    j = tot.join(within, "feature", "left")
    imp = (F.when((F.col("tv") == 0) | F.col("wv").isNull(), F.lit(0.0))
           .otherwise((F.col("tv") - F.col("wv")) / (F.col("wv") + 1e-10)))
    return j.select("feature", imp.alias("importance"))


def outlier_analysis(long: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """For noise points (-1) per feature: outlier mean / population std,
    overall mean, z = (outlier mean - overall mean) / (pop std + 1e-10)."""
    x = _labelled(long, labels, id_col, drop_noise=False)
    o = x.groupBy("feature").agg(
        F.avg(F.when(F.col("cluster") == NOISE, F.col("value"))).alias("outlier_mean"),
        F.stddev_pop(F.when(F.col("cluster") == NOISE, F.col("value"))).alias("outlier_std"),
        F.avg("value").alias("overall_mean"), F.stddev_pop("value").alias("overall_std"))
    return (o.where(F.col("outlier_mean").isNotNull())
            .withColumn("z_score", (F.col("outlier_mean") - F.col("overall_mean")) / (F.col("overall_std") + 1e-10))
            .drop("overall_std"))


def outlier_summary(labels: DataFrame, id_col: str) -> DataFrame:
    """K12 header: count and percentage of the noise label; ``outlier_members`` has its members."""
    return labels.agg(
        F.count_if(F.col("cluster") == NOISE).alias("n_outliers"),
        (F.count_if(F.col("cluster") == NOISE) * 100.0 / F.count(F.lit(1))).alias("outlier_percentage"))


def outlier_members(labels: DataFrame, id_col: str) -> DataFrame:
    """The members of the noise label, a row for each."""
    return labels.where(F.col("cluster") == NOISE).select(F.col(id_col).cast("string").alias("member"))
