"""Queries on fitted clusterings hang together: personas, exports, the whole analysis and the feature table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from tessera.operators import metrics
from tessera.plans import catalog_cluster as CC
from tessera.plans import catalog_models as M

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["county_fips"]: r["cluster"] for r in M.county_kmeans_labels(spark, SF).collect()}


def test_personas_are_of_the_fitted_clusters(spark, labels):
    got = {r["cluster_id"]: r for r in ent.queries()["n12_personas_of_kmeans_clusters"](spark, SF).collect()}
    assert set(got) == set(labels.values()) and len(got) >= 2
    for c, r in got.items():
        members = sorted(k for k, v in labels.items() if v == c)
        assert sorted(r["members"].split(",")) == members and r["estimated_population"] == len(members)
    found = ent.queries()["o01_opportunities_of_kmeans_clusters"](spark, SF).collect()
    names = {r["persona_name"] for r in got.values()}
    assert found and all(set(r["target_segments"]) <= names for r in found)


def test_whole_analysis(spark, labels):
    rows = M.analysis_of(spark, SF, M.county_kmeans_labels(spark, SF)).collect()
    by = {(r["section"], r["measure"]): r["value"] for r in rows if r["feature"] is None}
    assert by["size", "n_samples"] == len(labels) and by["size", "n_clusters"] == len(set(labels.values()))
    sil = metrics.silhouette_sq(CC.cluster_matrix(spark, SF), M.county_kmeans_labels(spark, SF), "county_fips").first()[0]
    assert by["internal", "silhouette_sq_euclidean"] == pytest.approx(sil)
    assert {r["section"] for r in rows} >= {"size", "internal", "geographic", "profile", "importance"}
    table = ent.queries()["k01_kmeans_optimal_counties"](spark, SF).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in table) == sorted(list(labels.values()).count(c) for c in set(labels.values()))


def test_feature_table(spark, labels):
    rows = ent.queries()["e09_feature_table"](spark, SF).collect()
    assert {r["county_fips"] for r in rows} == set(labels)
    names = {r["feature"] for r in rows}
    assert any(n.startswith("mobility_index_") for n in names)
    for n in sorted(names)[:5]:
        values = [r["value"] for r in rows if r["feature"] == n]
        assert len(values) == len(labels) and abs(sum(values) / len(values)) < 1e-3
