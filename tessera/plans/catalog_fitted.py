"""Registered queries on fitted clusterings of the counties: personas and what follows from them (K01 → K09 → N12 → O01),
per-algorithm exports (A11) and the features that E09 builds.  Labels are a model's, so SQL can't state them; tests compare
each query with the same operators on the labels, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.operators import personas as P
from tessera.plans import catalog_cluster as CC
from tessera.plans.catalog_models import FITTED, county_kmeans_labels
from tessera.plans.catalog_personas import _export_base, _flat, personas_of
from tessera.plans.context import context
from tessera.plans.registry import register


def fitted_personas(spark, d):
    """Personas of the best K-Means clustering."""
    return context(spark, d)._keep("fitted_personas", lambda: personas_of(spark, d, county_kmeans_labels(spark, d)))


@register("n12_personas_of_kmeans_clusters")
def n12_fitted(spark, d):
    """One persona for each cluster that K-Means finds."""
    return _flat(fitted_personas(spark, d))


@register("o01_opportunities_of_kmeans_clusters")
def o01_fitted(spark, d):
    return P.opportunities(fitted_personas(spark, d))


@register("h07_population_by_type_of_kmeans_clusters")
def h07_fitted(spark, d):
    return fitted_personas(spark, d).groupBy("persona_type").agg(
        F.sum("estimated_population").alias("population"), F.count(F.lit(1)).alias("personas"))


@register("a11_export_fitted_clusterings")
def a11_fitted(spark, d):
    """Assignments (CSV) and nested cluster profiles (JSON) of every algorithm, written and read again."""
    from tessera.sources import io
    base, out = _export_base(spark, "fitted_clustering"), None
    for name, fit in FITTED.items():
        labels = fit(spark, d)
        io.save_data(labels.select("county_fips", F.col("cluster").alias(f"{name}_cluster")), f"{base}/{name}_assignments.csv")
        profiles = metrics.cluster_profiles(CC.raw_long(spark, d), labels, "county_fips")
        io.export_json(profiles.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct(
            "feature", F.struct("mean", "median", "std", "min", "max", "count")))).alias("feature_statistics")), f"{base}/{name}_profiles")
        back = io.load_saved_data(spark, f"{base}/{name}_assignments.csv", schema=f"county_fips string, {name}_cluster int")
        profiled = spark.read.schema("cluster int").json(f"{base}/{name}_profiles").select(F.col("cluster").alias(f"{name}_cluster"))
        part = back.join(profiled.withColumn("profiled", F.lit(True)), f"{name}_cluster", "left").select(
            F.lit(name).alias("algorithm"), "county_fips", F.col(f"{name}_cluster").alias("cluster"),
            F.coalesce("profiled", F.lit(False)).alias("profiled"))
        out = part if out is None else out.unionByName(part)
    return out


@register("e09_feature_table")
def e09_features(spark, d):
    """What the feature pipeline builds: the kept scaled features of every county and its composite indices."""
    from tessera.plans.pipeline import feature_pipeline
    scaled, scores, _ = feature_pipeline(CC.county_features(spark, d), "county_fips", CC.CLUSTER_FEATURES)
    index = scores.select("county_fips", F.concat_ws("_", "index", F.col("component").cast("string")).alias("feature"), "value")
    return scaled.select("county_fips", "feature", "value").unionByName(index)
