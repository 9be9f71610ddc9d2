"""Registered queries: feature preparation (P01-P06, P08, P09, H12) and
label-driven cluster metrics (K03-K05, K08-K10, K12, T04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics, prep
from tessera.operators.neighbors import knn_join
from tessera.oracle.views import cte, with_
from tessera.plans import catalog_features  # noqa: F401  (registers the feature CTEs)
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import views

# Features profiled and clustered per county (mobility + spending mix).
MOBILITY_PART = [
    "total_trips", "avg_trip_duration_minutes", "avg_trip_distance_km", "member_ratio",
    "inter_county_ratio", "peak_hour_ratio", "weekend_ratio", "night_trips_ratio", "seasonal_variation",
]
SPENDING_PART = [
    "total_spending", "spending_pct_restaurants", "spending_pct_retail", "spending_pct_entertainment",
    "discretionary_ratio", "spending_diversity",
]
CLUSTER_FEATURES = MOBILITY_PART + SPENDING_PART


def county_features(spark, d):
    """E04 ⋈ E08 (inner on county), restricted to CLUSTER_FEATURES."""
    ctx = context(spark, d)
    mob = ctx.mobility_features().select("county_fips", *MOBILITY_PART)
    sp = ctx.spending_features().select("county_fips", *SPENDING_PART)
    return ctx._keep("county_features", lambda: mob.join(sp, "county_fips"))


def cluster_matrix(spark, d):
    """P08 then P05: median-imputed, zero-variance-free, standardized."""
    wide = county_features(spark, d)
    long = prep.prepare_clustering_data(wide, "county_fips", CLUSTER_FEATURES)
    scaled, _ = prep.standardize(long)
    return scaled


def raw_long(spark, d):
    return prep.to_long(county_features(spark, d), "county_fips", CLUSTER_FEATURES)


# ----------------------------------------------------------- DuckDB twins
_FEATS = ", ".join(CLUSTER_FEATURES)
cte("cluster_raw", "SELECT m.county_fips, " + ", ".join(f"CAST(m.{c} AS DOUBLE) AS {c}" for c in MOBILITY_PART)
    + ", " + ", ".join(f"CAST(s.{c} AS DOUBLE) AS {c}" for c in SPENDING_PART)
    + " FROM mobility_features m JOIN spend_features s ON m.county_fips = s.county_fips",
    ("mobility_features", "spend_features"))
cte("raw_long", f"SELECT county_fips, feature, value FROM cluster_raw UNPIVOT INCLUDE NULLS (value FOR feature IN ({_FEATS}))",
    ("cluster_raw",))
cte("prepared_long", """
SELECT * FROM (
  SELECT r.county_fips, r.feature, coalesce(r.value, m.med) AS value
  FROM raw_long r JOIN (SELECT feature, median(value) AS med FROM raw_long GROUP BY feature) m
    ON r.feature = m.feature) AS x
WHERE feature NOT IN (SELECT feature FROM (
  SELECT r.feature, var_samp(coalesce(r.value, m.med)) AS v
  FROM raw_long r JOIN (SELECT feature, median(value) AS med FROM raw_long GROUP BY feature) m
    ON r.feature = m.feature GROUP BY r.feature) AS z WHERE coalesce(v, 0) = 0)""", ("raw_long",))
cte("scaled_long", """
SELECT p.county_fips, p.feature,
       (p.value - s.mu) / CASE WHEN s.sd = 0 THEN 1.0 ELSE s.sd END AS value
FROM prepared_long p JOIN (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM prepared_long
                           GROUP BY feature) s ON p.feature = s.feature""", ("prepared_long",))
cte("labels", """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_fips,
       CASE WHEN n_nationkey % 7 = 3 THEN -1 ELSE n_nationkey % 4 END AS cluster FROM nation""")
cte("lab_long", """
SELECT s.county_fips, s.feature, s.value, l.cluster FROM scaled_long s JOIN labels l
  ON s.county_fips = l.county_fips WHERE l.cluster <> -1""", ("scaled_long", "labels"))


# --------------------------------------------------------------- queries
@register("p08_prepare_clustering_data", with_("prepared_long") + "SELECT * FROM prepared_long", ("value",), digits=4)
def p08(spark, d):
    return prep.prepare_clustering_data(county_features(spark, d), "county_fips", CLUSTER_FEATURES)


@register("p05_standardize_features", with_("scaled_long") + "SELECT * FROM scaled_long", ("value",))
def p05(spark, d):
    return cluster_matrix(spark, d)


@register("p06_normalize_minmax", with_("prepared_long") + """
SELECT p.county_fips, p.feature, (p.value - s.a) / nullif(s.b, 0) AS value
FROM prepared_long p JOIN (SELECT feature, min(value) AS a, max(value) - min(value) AS b FROM prepared_long
                           GROUP BY feature) s ON p.feature = s.feature""", ("value",))
def p06(spark, d):
    long = prep.prepare_clustering_data(county_features(spark, d), "county_fips", CLUSTER_FEATURES)
    return prep.normalize(long, "minmax")[0]


@register("p06_normalize_robust", with_("prepared_long") + """
SELECT p.county_fips, p.feature, (p.value - s.a) / nullif(s.b, 0) AS value
FROM prepared_long p JOIN (
  SELECT x.feature, any_value(m.a) AS a, median(abs(x.value - m.a)) AS b
  FROM prepared_long x JOIN (SELECT feature, median(value) AS a FROM prepared_long GROUP BY feature) m
    ON x.feature = m.feature GROUP BY x.feature) s ON p.feature = s.feature""", ("value",))
def p06r(spark, d):
    long = prep.prepare_clustering_data(county_features(spark, d), "county_fips", CLUSTER_FEATURES)
    return prep.normalize(long, "robust")[0]


@register("p06_normalize_standard", with_("prepared_long") + """
SELECT p.county_fips, p.feature, (p.value - s.a) / nullif(s.b, 0) AS value
FROM prepared_long p JOIN (SELECT feature, avg(value) AS a, stddev_samp(value) AS b FROM prepared_long
                           GROUP BY feature) s ON p.feature = s.feature""", ("value",))
def p06s(spark, d):
    long = prep.prepare_clustering_data(county_features(spark, d), "county_fips", CLUSTER_FEATURES)
    return prep.normalize(long, "standard")[0]


@register("p01_skew_detection", with_("raw_long") + """
SELECT feature, skewness(value) AS skew, coalesce(abs(skewness(value)) > 1.0, false) AS skewed
FROM raw_long GROUP BY feature""", ("skew",), digits=5)
def p01(spark, d):
    return prep.skewness(raw_long(spark, d))


@register("p02_log_transform", with_("raw_long") + """
SELECT r.county_fips, r.feature,
       CASE WHEN s.shift IS NOT NULL THEN ln(1 + r.value + s.shift) ELSE r.value END AS value
FROM raw_long r JOIN (SELECT feature, CASE WHEN min(value) <= 0 THEN abs(min(value)) + 1 END AS shift
                      FROM raw_long GROUP BY feature) s ON r.feature = s.feature""", ("value",), digits=5)
def p02(spark, d):
    return prep.log_transform(raw_long(spark, d))[0]


_CORR_FEATS = CLUSTER_FEATURES


def _corr_sql() -> str:
    pos = " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS pos" for i, f in enumerate(_CORR_FEATS))
    return with_("raw_long") + f""", pos AS ({pos}),
cen AS (SELECT r.county_fips, r.feature, r.value - m.mu AS c
        FROM raw_long r JOIN (SELECT feature, avg(value) AS mu FROM raw_long GROUP BY feature) m
          ON r.feature = m.feature)
SELECT a.feature AS feature_i, b.feature AS feature_j, CAST(pa.pos AS BIGINT) AS pos_i,
       CAST(pb.pos AS BIGINT) AS pos_j,
       sum(a.c * b.c) / nullif(sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 0) AS corr
FROM cen a JOIN cen b ON a.county_fips = b.county_fips
JOIN pos pa ON a.feature = pa.feature JOIN pos pb ON b.feature = pb.feature
GROUP BY a.feature, b.feature, pa.pos, pb.pos"""


@register("h12_correlation_matrix", _corr_sql(), ("corr",), digits=6)
def h12(spark, d):
    return prep.correlation_pairs(county_features(spark, d), _CORR_FEATS)


@register("p04_remove_correlated_features", f"""SELECT DISTINCT feature_j AS feature, pos_j FROM ({_corr_sql()}) AS c
WHERE pos_i < pos_j AND coalesce(abs(corr) > 0.85, false)""")
def p04(spark, d):
    return prep.correlated_to_drop(prep.correlation_pairs(county_features(spark, d), _CORR_FEATS), 0.85)


@register("p09_geographic_clustering_prep", with_("county_mobility") + """
SELECT county_fips, coalesce(centroid_lat, avg(centroid_lat) OVER ()) AS lat,
       coalesce(centroid_lng, avg(centroid_lng) OVER ()) AS lng FROM county_mobility""", ("lat", "lng"))
def p09(spark, d):
    mob = context(spark, d).county_mobility()
    long = prep.mean_impute(prep.to_long(mob.select("county_fips", F.col("centroid_lat").alias("lat"),
                                                    F.col("centroid_lng").alias("lng")),
                                         "county_fips", ["lat", "lng"]))
    return prep.to_wide(long, "county_fips", ["lat", "lng"])


def _labels(spark, d):
    return views.assignments(spark, d)


_SIL_SQL = with_("lab_long") + """,
cstat AS (SELECT cluster, feature, sum(value) AS sy, sum(value * value) AS syy FROM lab_long GROUP BY cluster, feature),
csize AS (SELECT cluster, count(DISTINCT county_fips) AS nc FROM lab_long GROUP BY cluster),
norms AS (SELECT county_fips, sum(value * value) AS xx FROM lab_long GROUP BY county_fips),
crossd AS (SELECT x.county_fips, x.cluster AS own, c.cluster, sum(x.value * c.sy) AS xs, sum(c.syy) AS syy
           FROM lab_long x JOIN cstat c ON x.feature = c.feature GROUP BY x.county_fips, x.cluster, c.cluster),
d AS (SELECT cr.*, cs.nc, n.xx, n.xx + (cr.syy - 2 * cr.xs) / cs.nc AS dis
      FROM crossd cr JOIN csize cs ON cr.cluster = cs.cluster JOIN norms n ON cr.county_fips = n.county_fips),
per AS (SELECT county_fips, own,
               max(CASE WHEN cluster = own THEN dis * nc / CASE WHEN nc > 1 THEN nc - 1 END END) AS a,
               max(CASE WHEN cluster = own THEN nc END) AS own_n,
               min(CASE WHEN cluster <> own THEN dis END) AS b FROM d GROUP BY county_fips, own)
SELECT CASE WHEN k > 1 AND k < n THEN s ELSE -1.0 END AS silhouette_sq_euclidean, n, k FROM
  (SELECT avg(CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END) AS s
   FROM per) AS q,
  (SELECT count(DISTINCT county_fips) AS n, count(DISTINCT cluster) AS k FROM lab_long) AS nk"""


@register("k03_silhouette", _SIL_SQL, ("silhouette_sq_euclidean",))
def k03(spark, d):
    return metrics.silhouette_sq(cluster_matrix(spark, d), _labels(spark, d), "county_fips")


@register("k04_calinski_harabasz", with_("lab_long") + """,
cm AS (SELECT cluster, feature, avg(value) AS mc, count(value) AS nc FROM lab_long GROUP BY cluster, feature),
ov AS (SELECT feature, avg(value) AS mu FROM lab_long GROUP BY feature),
nk AS (SELECT count(DISTINCT county_fips) AS n, count(DISTINCT cluster) AS k FROM lab_long)
SELECT CASE WHEN k > 1 THEN (bb / (k - 1)) / nullif(ww / (n - k), 0) ELSE -1.0 END AS calinski_harabasz, n, k
FROM (SELECT sum(cm.nc * power(cm.mc - ov.mu, 2)) AS bb FROM cm JOIN ov ON cm.feature = ov.feature) AS b,
     (SELECT sum(power(x.value - cm.mc, 2)) AS ww FROM lab_long x JOIN cm ON x.cluster = cm.cluster
        AND x.feature = cm.feature) AS w, nk""", ("calinski_harabasz",), digits=5)
def k04(spark, d):
    return metrics.calinski_harabasz(cluster_matrix(spark, d), _labels(spark, d), "county_fips")


@register("k05_davies_bouldin", with_("lab_long") + """,
cm AS (SELECT cluster, feature, avg(value) AS mc FROM lab_long GROUP BY cluster, feature),
dist AS (SELECT x.county_fips, x.cluster, sqrt(sum(power(x.value - cm.mc, 2))) AS d
         FROM lab_long x JOIN cm ON x.cluster = cm.cluster AND x.feature = cm.feature GROUP BY x.county_fips, x.cluster),
spread AS (SELECT cluster, avg(d) AS s FROM dist GROUP BY cluster),
dij AS (SELECT a.cluster AS ci, b.cluster AS cj, sqrt(sum(power(a.mc - b.mc, 2))) AS dij
        FROM cm a JOIN cm b ON a.feature = b.feature AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
per AS (SELECT dij.ci, max((si.s + sj.s) / nullif(dij.dij, 0)) AS rmax FROM dij
        JOIN spread si ON dij.ci = si.cluster JOIN spread sj ON dij.cj = sj.cluster GROUP BY dij.ci),
nk AS (SELECT count(DISTINCT county_fips) AS n, count(DISTINCT cluster) AS k FROM lab_long)
SELECT CASE WHEN k > 1 THEN (SELECT avg(rmax) FROM per) ELSE -1.0 END AS davies_bouldin, n, k FROM nk""",
          ("davies_bouldin",))
def k05(spark, d):
    return metrics.davies_bouldin(cluster_matrix(spark, d), _labels(spark, d), "county_fips")


def county_knn_edges(spark, d, k=3):
    """J08 on county centroids: k = min(3, n - 1) nearest, self excluded."""
    from tessera.operators import spatial
    prepared = spatial.prepare_boundaries(views.boundaries(spark, d))
    pts = prepared.select(F.col("county_fips").cast("long").alias("pid"),
                          F.col("centroid_lng").alias("x"), F.col("centroid_lat").alias("y"))
    n = pts.count()
    kk = min(k, n - 1)
    nn = knn_join(pts, pts.withColumnRenamed("pid", "tid"), kk, exclude_self=True)
    return nn.select(F.lpad(F.col("pid").cast("string"), 5, "0").alias("i"),
                     F.lpad(F.col("tid").cast("string"), 5, "0").alias("j"))


@register("k08_morans_i", with_("bnd", "labels") + """,
e AS (SELECT i, j FROM (SELECT a.county_fips AS i, b.county_fips AS j,
        row_number() OVER (PARTITION BY a.county_fips ORDER BY
          sqrt(power(b.centroid_lng - a.centroid_lng, 2) + power(b.centroid_lat - a.centroid_lat, 2)),
          b.county_fips) AS r
      FROM bnd a JOIN bnd b ON a.county_fips <> b.county_fips) AS x WHERE r <= 3),
y AS (SELECT county_fips AS i, CAST(CASE WHEN cluster = -1 THEN (SELECT max(cluster) FROM labels WHERE cluster <> -1) + 1
                                    ELSE cluster END AS DOUBLE) AS y FROM labels),
z AS (SELECT i, y - (SELECT avg(y) FROM y) AS z FROM y),
w AS (SELECT e.i, e.j, 1.0 / count(*) OVER (PARTITION BY e.i) AS w FROM e),
both_ AS (SELECT coalesce(w.i, r.i) AS i, coalesce(w.j, r.j) AS j, coalesce(w.w, 0) AS w, coalesce(r.w, 0) AS wr
          FROM w FULL OUTER JOIN (SELECT j AS i, i AS j, w FROM w) r ON w.i = r.i AND w.j = r.j),
deg AS (SELECT coalesce(o.i, n.i) AS i, coalesce(o.o, 0) AS o, coalesce(n.n, 0) AS n
        FROM (SELECT i, sum(w) AS o FROM w GROUP BY i) o FULL OUTER JOIN (SELECT j AS i, sum(w) AS n FROM w GROUP BY j) n
        ON o.i = n.i),
st AS (SELECT (SELECT count(*) FROM y) AS n, (SELECT sum(w) FROM w) AS s0,
              (SELECT 0.5 * sum(power(w + wr, 2)) FROM both_) AS s1, (SELECT sum(power(o + n, 2)) FROM deg) AS s2,
              (SELECT sum(w.w * zi.z * zj.z) FROM w JOIN z zi ON w.i = zi.i JOIN z zj ON w.j = zj.i) AS num,
              (SELECT sum(z * z) FROM z) AS den),
r AS (SELECT n / s0 * num / den AS mi, -1.0 / (n - 1) AS ei,
             (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - (1.0 / (n - 1)) * (1.0 / (n - 1)) AS v
      FROM st)
SELECT mi AS morans_i, (mi - ei) / sqrt(v) AS morans_i_zscore,
       CASE WHEN mi > 0 THEN 'positive' WHEN mi < 0 THEN 'negative' ELSE 'none' END AS spatial_autocorrelation
FROM r""", ("morans_i", "morans_i_zscore"))
def k08(spark, d):
    """Moran's I of the fixed labels on county-centroid kNN weights (the
    p-value uses an erf polynomial; checked in pytest, not here)."""
    edges = county_knn_edges(spark, d)
    r = metrics.morans_i(_labels(spark, d), None, "county_fips", edges)
    return r.select("morans_i", "morans_i_zscore", "spatial_autocorrelation")


_PROF_SQL = with_("raw_long", "labels") + """,
x AS (SELECT r.county_fips, r.feature, r.value, l.cluster FROM raw_long r JOIN labels l ON r.county_fips = l.county_fips),
ov AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM x GROUP BY feature),
pr AS (SELECT x.cluster, x.feature, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
              min(value) AS min, max(value) AS max, count(value) AS count FROM x GROUP BY x.cluster, x.feature)
SELECT pr.*, (pr.mean - ov.mu) / nullif(ov.sd, 0) AS z_score FROM pr JOIN ov ON pr.feature = ov.feature"""


@register("k09_cluster_profiles", _PROF_SQL,
          (("mean", 2), ("median", 2), ("std", 2), ("min", 2), ("max", 2), ("z_score", 6)))
def k09(spark, d):
    return metrics.cluster_profiles(raw_long(spark, d), _labels(spark, d), "county_fips")


@register("t04_top_distinguishing_features", f"""
SELECT CAST(cluster AS BIGINT) AS cluster, feature, z_score, rank FROM (
  SELECT cluster, feature, z_score, row_number() OVER (PARTITION BY cluster ORDER BY abs(z_score) DESC, feature) AS rank
  FROM ({_PROF_SQL}) AS p WHERE z_score IS NOT NULL) AS q WHERE rank <= 5""", ("z_score",))
def t04(spark, d):
    prof = metrics.cluster_profiles(raw_long(spark, d), _labels(spark, d), "county_fips")
    return metrics.distinguishing_features(prof, 5)


@register("k09_cluster_summary", with_("labels") + """
SELECT cluster, county_fips AS member, count(*) OVER (PARTITION BY cluster) AS size FROM labels""")
def k09s(spark, d):
    return metrics.cluster_summary(_labels(spark, d), "county_fips")


@register("k10_variance_ratio_importance", with_("lab_long") + """,
tot AS (SELECT feature, var_pop(value) AS tv FROM lab_long GROUP BY feature),
per AS (SELECT feature, cluster, var_pop(value) AS v, count(value) AS m FROM lab_long GROUP BY feature, cluster),
wi AS (SELECT feature, sum(v * m) / sum(m) AS wv FROM per WHERE m > 1 GROUP BY feature)
SELECT tot.feature, CASE WHEN tv = 0 OR wv IS NULL THEN 0.0 ELSE (tv - wv) / (wv + 1e-10) END AS importance
FROM tot LEFT JOIN wi ON tot.feature = wi.feature""", ("importance",), digits=5)
def k10(spark, d):
    return metrics.variance_ratio_importance(cluster_matrix(spark, d), _labels(spark, d), "county_fips")


@register("t05_top_important_features", with_("lab_long") + """,
tot AS (SELECT feature, var_pop(value) AS tv FROM lab_long GROUP BY feature),
per AS (SELECT feature, cluster, var_pop(value) AS v, count(value) AS m FROM lab_long GROUP BY feature, cluster),
wi AS (SELECT feature, sum(v * m) / sum(m) AS wv FROM per WHERE m > 1 GROUP BY feature)
SELECT tot.feature, CASE WHEN tv = 0 OR wv IS NULL THEN 0.0 ELSE (tv - wv) / (wv + 1e-10) END AS importance
FROM tot LEFT JOIN wi ON tot.feature = wi.feature ORDER BY importance DESC, feature LIMIT 10""",
          ("importance",), digits=5)
def t05(spark, d):
    imp = metrics.variance_ratio_importance(cluster_matrix(spark, d), _labels(spark, d), "county_fips")
    return imp.orderBy(F.desc("importance"), F.asc("feature")).limit(10)


_OUT_SQL = with_("scaled_long", "labels") + """,
x AS (SELECT s.county_fips, s.feature, s.value, l.cluster FROM scaled_long s JOIN labels l
        ON s.county_fips = l.county_fips)
SELECT feature, avg(value) FILTER (WHERE cluster = -1) AS outlier_mean,
       stddev_pop(value) FILTER (WHERE cluster = -1) AS outlier_std, avg(value) AS overall_mean,
       (avg(value) FILTER (WHERE cluster = -1) - avg(value)) / (stddev_pop(value) + 1e-10) AS z_score
FROM x GROUP BY feature HAVING avg(value) FILTER (WHERE cluster = -1) IS NOT NULL"""


@register("k12_analyze_outliers", _OUT_SQL, ("outlier_mean", "outlier_std", "overall_mean", "z_score"))
def k12(spark, d):
    return metrics.outlier_analysis(cluster_matrix(spark, d), _labels(spark, d), "county_fips")


@register("t06_top_extreme_outlier_features", f"""
SELECT feature, abs(z_score) AS abs_z_score FROM ({_OUT_SQL}) AS o ORDER BY abs(z_score) DESC, feature LIMIT 5""",
          ("abs_z_score",))
def t06(spark, d):
    o = metrics.outlier_analysis(cluster_matrix(spark, d), _labels(spark, d), "county_fips")
    return (o.select("feature", F.abs("z_score").alias("abs_z_score"))
            .orderBy(F.desc("abs_z_score"), F.asc("feature")).limit(5))


@register("k12_outlier_summary", with_("labels") + """
SELECT count_if(cluster = -1) AS n_outliers, count_if(cluster = -1) * 100.0 / count(*) AS outlier_percentage
FROM labels""", ("outlier_percentage",))
def k12s(spark, d):
    return metrics.outlier_summary(_labels(spark, d), "county_fips")


@register("k12_outlier_members", with_("labels") + "SELECT county_fips AS member FROM labels WHERE cluster = -1")
def k12m(spark, d):
    return metrics.outlier_members(_labels(spark, d), "county_fips")


@register("p03_yeo_johnson_fixed_lambda", with_("raw_long") + """
SELECT county_fips, feature, CASE WHEN value >= 0 THEN (power(value + 1, 0.5) - 1) / 0.5
                                  ELSE -(power(1 - value, 1.5) - 1) / 1.5 END AS value FROM raw_long""",
          ("value",), digits=4)
def p03_fixed(spark, d):
    """Yeo-Johnson transform of every county feature at λ = 0.5."""
    return raw_long(spark, d).withColumn("value", prep.yeo_johnson(F.col("value"), F.lit(0.5)))


@register("p03_box_cox_fixed_lambda", with_("raw_long") + """
SELECT county_fips, feature, (power(value, 0.5) - 1) / 0.5 AS value FROM raw_long
WHERE feature IN (SELECT feature FROM raw_long GROUP BY feature HAVING min(value) > 0)""", ("value",), digits=4)
def p03_box_cox(spark, d):
    """Box-Cox transform at λ = 0.5 of the county features that are positive throughout."""
    long = raw_long(spark, d)
    positive = long.groupBy("feature").agg(F.min("value").alias("least")).where("least > 0").select("feature")
    return long.join(positive, "feature", "left_semi").withColumn("value", prep.box_cox(F.col("value"), F.lit(0.5)))


@register("p03_box_cox_lambdas")
def p03_bc(spark, d):
    """Maximum-likelihood Box-Cox λ per positive county feature."""
    return prep.fit_box_cox(raw_long(spark, d))


@register("p03_yeo_johnson_lambdas")
def p03(spark, d):
    """Maximum-likelihood Yeo-Johnson λ per skewed county feature."""
    long = raw_long(spark, d)
    skewed = [r[0] for r in prep.skewness(long).where("skewed").select("feature").collect()]
    return prep.fit_yeo_johnson(long.where(F.col("feature").isin(*skewed)))


@register("p07_composite_indices")
def p07(spark, d):
    """PCA composite indices (mobility / spending / temporal) with the
    explained-variance ratio of each component."""
    from tessera.plans.pipeline import composite_indices
    scores, var = composite_indices(cluster_matrix(spark, d), "county_fips")
    return scores.join(var, ["index", "component"])


@register("e09_create_feature_pipeline")
def e09(spark, d):
    """E04 ⋈ E08 → skew → Yeo-Johnson → correlation pruning → scaling → PCA;
    returns the step log (feature counts per step)."""
    from tessera.plans.pipeline import feature_pipeline
    _, _, steps = feature_pipeline(county_features(spark, d), "county_fips", CLUSTER_FEATURES)
    return steps
