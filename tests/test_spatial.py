"""Spatial operators on the reference's hand-made fixtures (FIXTURES.md §1)."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import quality, spatial

T0 = dt.datetime(2023, 6, 1, 8, 0)
TRIP_SCHEMA = ("trip_id string, start_time timestamp_ntz, end_time timestamp_ntz, start_station_id long, "
               "end_station_id long, start_lat double, start_lng double, end_lat double, end_lng double, "
               "member_type string")
STATION = {1: (41.90, -87.65), 2: (41.88, -87.63), 3: (41.92, -87.55)}


def _trip(i, s, e, minutes, member):
    return (f"00{i}", T0, T0 + dt.timedelta(minutes=minutes), s, e, *STATION[s], *STATION[e], member)


@pytest.fixture()
def trips(spark):
    rows = [_trip(1, 1, 2, 15, "member"), _trip(2, 2, 3, 20, "member"), _trip(3, 1, 3, 10, "casual"),
            _trip(4, 3, 1, 25, "member")]
    return spark.createDataFrame(rows, TRIP_SCHEMA)


def _square(fips, x0, x1, y0, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return (fips, f"c{fips}", [{"lng": a, "lat": b} for a, b in ring], 4326)


@pytest.fixture()
def boundaries(spark):
    rows = [_square("17031", -87.70, -87.60, 41.85, 41.95), _square("17043", -87.60, -87.50, 41.85, 41.95)]
    return spark.createDataFrame(rows, "county_fips string, county_name string, "
                                       "ring array<struct<lng:double,lat:double>>, srid int")


def test_extract_stations_counts(trips):
    st = {r.station_id: r for r in spatial.extract_stations(trips).collect()}
    assert set(st) == {1, 2, 3}
    assert st[1].trip_count == 3  # two starts + one end
    assert sum(r.trip_count for r in st.values()) == 8
    assert st[1].lat == pytest.approx(41.90)


def test_assignment_and_aggregation(trips, boundaries):
    prepared = spatial.prepare_boundaries(boundaries)
    assigned = {r.station_id: r.county_fips for r in
                spatial.assign_stations(spatial.extract_stations(trips), prepared).collect()}
    assert assigned == {1: "17031", 2: "17031", 3: "17043"}
    m = spatial.station_county_map(spatial.assign_stations(spatial.extract_stations(trips), prepared))
    enriched = spatial.add_trip_metrics(spatial.add_county_info(trips, m))
    agg = {r.county_fips: r for r in spatial.county_aggregation(enriched).collect()}
    assert sum(r.total_trips for r in agg.values()) == 4
    for r in agg.values():
        assert r.member_trips + r.casual_trips == r.total_trips
    assert agg["17031"].total_trips == 3 and agg["17031"].inter_county_trips == 2
    assert agg["17031"].median_trip_duration_minutes == pytest.approx(15.0)


def test_boundary_point_is_not_inside(spark, boundaries):
    prepared = spatial.prepare_boundaries(boundaries)
    pts = spark.createDataFrame([(9, 41.90, -87.60), (8, 41.90, -87.65)], "station_id long, lat double, lng double")
    inside = spatial.points_in_polygons(pts, prepared).collect()
    assert [(r.station_id, r.county_fips) for r in inside] == [(8, "17031")]
    near = spatial.nearest_centroid(pts.where("station_id = 9"), prepared).collect()
    assert near[0].county_fips in {"17031", "17043"}


def test_l_shaped_ring(spark):
    ring = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]
    df = spark.createDataFrame([([{"lng": float(a), "lat": float(b)} for a, b in ring],)],
                               "ring array<struct<lng:double,lat:double>>")
    pts = [(0.5, 0.5, True), (1.5, 1.5, False), (1.5, 0.5, True), (0.5, 1.5, True), (1.0, 1.5, False)]
    for x, y, expect in pts:
        got = df.select(geo.point_in_ring_strict(F.col("ring"), F.lit(x), F.lit(y))).first()[0]
        assert got is expect, (x, y)
    assert quality.valid_rings(df).first()["ring_valid"] is True
    bow = [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]
    bad = spark.createDataFrame([([{"lng": float(a), "lat": float(b)} for a, b in bow],)],
                                "ring array<struct<lng:double,lat:double>>")
    assert quality.valid_rings(bad).first()["ring_valid"] is False


def test_area_and_centroid(boundaries):
    p = {r.county_fips: r for r in spatial.prepare_boundaries(boundaries).collect()}
    r = p["17031"]
    expected = 6371.0 ** 2 * math.radians(0.1) * (math.sin(math.radians(41.95)) - math.sin(math.radians(41.85)))
    assert r.area_sq_km == pytest.approx(expected, rel=1e-9)
    assert r.area_sq_km_mercator > r.area_sq_km  # Web Mercator inflates areas
    assert r.centroid_lat == pytest.approx(41.90) and r.centroid_lng == pytest.approx(-87.65)


def test_haversine_and_direction(spark):
    df = spark.range(1).select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"),
        geo.compass_direction(F.lit(22.5)).alias("n"),   # 0.5 rounds half-even to 0
        geo.compass_direction(F.lit(67.5)).alias("e"),   # 1.5 rounds half-even to 2
        geo.distance_category(F.lit(4.99)).alias("c"))
    r = df.first()
    assert r.d == pytest.approx(111.19, abs=0.01)
    assert (r.n, r.e, r.c) == ("N", "E", "Medium")


def test_bad_coordinates_reported(spark, trips):
    bad = trips.withColumn("start_lat", F.when(F.col("trip_id") == "001", F.lit(91.0)).otherwise(F.col("start_lat")))
    rules = {r.rule: r for r in quality.trip_rules(bad).collect()}
    assert rules["invalid_coordinates"].n_bad == 1


def test_missing_columns_fail(trips):
    rows = quality.trip_rules(trips.select("trip_id", "start_time")).collect()
    assert rows[0].rule == "missing_columns" and rows[0].n_bad == 7 and rows[0].flagged
