"""Rules that hold at every size: all categories count, no cap on rounds, ids of any type, ε as given, faults survive."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import density, quality, spatial, spending
from tessera.operators.components import connected_components

EIGHT = quality.EXPECTED_CATEGORIES


def test_every_category_counts(spark):
    rows = [(f"0000{c}", 2023, m, cat, float(10 * (k + 1) + m + c)) for c in range(3) for m in (1, 2, 3) for k, cat in enumerate(EIGHT)]
    rows.append(("00009", 2023, 1, "education", 50.0))
    rows.append(("00009", 2023, 1, "retail", 10.0))
    s = spark.createDataFrame(rows, "county_fips string, year int, month int, category string, spending_amount double")
    population = spark.createDataFrame([("00009", 2023, 100)], "county_fips string, year int, population long")
    out = {r["county_fips"]: r for r in spending.create_spending_features(s, population).collect()}
    assert out["00009"]["total_spending"] == 60.0
    assert out["00009"]["spending_pct_retail"] == pytest.approx(1 / 6)
    assert out["00009"]["dominant_spending_category"] == "spending_pct_education"
    assert out["00009"]["spending_per_capita_education"] == pytest.approx(0.5)
    for c in range(3):
        want = sum(r[4] for r in rows if r[0] == f"0000{c}")
        assert out[f"0000{c}"]["total_spending"] == pytest.approx(want)
        assert sum(out[f"0000{c}"][f"spending_pct_{k}"] for k in EIGHT) == pytest.approx(1.0)
    assert set(spending.pivot_spending(s).columns) == {"county_fips", *[f"spending_{k}" for k in EIGHT]}
    med = spending.aggregate_spending(s, ["category"], {"spending_amount": ["median", "sum"]}).collect()
    for r in med:
        own = [x[4] for x in rows if x[3] == r["category"]]
        assert r["spending_amount_median"] == pytest.approx(np.median(own))


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(80)] + [(200, 201), (300, 300), (None, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(81)}, 200: 200, 201: 200}
    nodes = spark.createDataFrame([(k,) for k in (0, 80, 200, 999)], "pid long")
    own = density.connected_components(nodes, edges.withColumnsRenamed({"u": "src", "v": "dst"}))
    assert {r["pid"]: r["component"] for r in own.collect()} == {0: 0, 80: 0, 200: 200, 999: 999}


@pytest.mark.parametrize("epsilon", [0.0, 0.15, 0.4, 3.0])
def test_range_links_have_the_components_of_all_pairs(spark, epsilon):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.uniform(0, 4, (150, 2)), rng.normal([1, 1], 0.05, (60, 2)), np.repeat([[3.3, 3.3]], 4, 0)])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "pid long, x double, y double")
    label = list(range(len(pts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(pts)):
        for b in range(a):
            if math.dist(pts[a], pts[b]) <= epsilon:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    got = density.connected_components(df.select("pid"), density.range_links(df, epsilon)).collect()
    assert {r["pid"]: r["component"] for r in got} == {k: root(k) for k in range(len(pts))}


def test_text_station_ids(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    points = [{"lng": x, "lat": y} for x, y in ring]
    b = spark.createDataFrame([("17031", "A", points, 4326)], "county_fips string, county_name string, "
                              "ring array<struct<lng:double,lat:double>>, srid int")
    st = spark.createDataFrame([("TA1307000039", 0.5, 0.5, 3), ("KA15", 2.0, 2.0, 1)],
                               "station_id string, lat double, lng double, trip_count long")
    got = {r["station_id"]: r["assignment"] for r in spatial.assign_stations(st, spatial.prepare_boundaries(b)).collect()}
    assert got == {"TA1307000039": "within", "KA15": "nearest_centroid"}


def test_rules_read_text_times_and_empty_rings(spark):
    t = spark.createDataFrame([("1", "2023-06-01 10:00:00", "2023-06-01 09:00:00"), ("2", "not a date", "2023-06-01 09:00:00"), ("3", None, None)],
                              "trip_id string, start_time string, end_time string")
    rest = {c: F.lit(1.0) for c in quality.TRIP_REQUIRED if c not in t.columns} | {"member_type": F.lit("vip")}
    rules = {r["rule"]: r["n_bad"] for r in quality.trip_rules(t.withColumns(rest)).collect()}
    assert rules["date_parse_errors"] == 1 and rules["negative_durations"] == 1 and rules["invalid_member_types"] == 1
    b = spark.createDataFrame([("00001", []), ("00002", None)], "county_fips string, ring array<struct<lng:double,lat:double>>")
    rules = {r["rule"]: r["n_bad"] for r in quality.boundary_rules(b).collect()}
    assert rules["empty_geometry"] == 2 and rules["invalid_geometry"] == 0
