"""Crossings and points in polygons against the forms that test every edge."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import quality, rings, spatial

RING = "ring array<struct<lng:double,lat:double>>"


def _ring(points):
    return [{"lng": float(x), "lat": float(y)} for x, y in points]


def wavy(n, x=0.0, y=0.0, size=1.0, wobble=0.3):
    """A star-shaped ring of n + 1 points, which never crosses itself."""
    t = np.arange(n) * 2 * math.pi / n
    r = size * (1 + wobble * np.sin(17 * t) + 0.05 * np.cos(np.arange(n) * 2.4))
    pts = np.stack([x + r * np.cos(t), y + r * np.sin(t)], 1).tolist()
    return pts + pts[:1]


def test_crossings_equal_all_pairs_of_edges(spark):
    rng = np.random.default_rng(5)
    shapes = [wavy(n) for n in (5, 12, 60)] + [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], [], None]
    for n in (4, 5, 6, 9):
        for scale in (1.0, 1e-3):
            pts = (rng.normal(size=(n, 2)) * scale).tolist()
            shapes.append(pts + pts[:1])
    shapes.append([(0, 0), (100, 0), (100, 1e-4), (50, -1e-4), (0, 1e-4), (0, 0)])  # short edges across a long one
    shapes += [shapes[3], [(0, 0), (2, 0), (2, 2), (1, 0), (0, 2), (0, 0)]]  # a repeated ring; one that touches itself
    df = spark.createDataFrame([(i, None if s is None else _ring(s)) for i, s in enumerate(shapes)], "id int, " + RING)
    bad = rings.crossing_rings(df).withColumn("bad", F.lit(True))
    got = {r.id: bool(r.bad) for r in df.withColumn("key", rings.ring_key("ring")).join(bad, "key", "left").collect()}

    def turn(a, b, c):
        return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    for i, s in enumerate(shapes):
        e = list(zip(s or [], (s or [])[1:]))
        want = any(turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
                   for k, (a, b) in enumerate(e) for c, d in e[k + 1:])
        assert got[i] == want, i
    assert any(got.values()) and not all(got.values())


def test_large_rings_take_seconds(spark):
    good = wavy(100_000)
    bad = list(good)
    bad[70_000] = [-3 * c for c in bad[70_000]]  # beyond the other side: two long edges cross short ones
    df = spark.createDataFrame([("00001", _ring(good), 4326), ("00002", _ring(bad), 4326), ("00003", _ring(wavy(8)), 4326)],
                               f"county_fips string, {RING}, srid int").repartition(3)
    start = time.time()
    rules = {r["rule"]: r["n_bad"] for r in quality.boundary_rules(df).collect()}
    assert rules["invalid_geometry"] == 1 and rules["empty_geometry"] == 0
    assert time.time() - start < 120


def test_points_equal_whole_ring_test(spark):
    shapes = {"00001": wavy(50_000), "00002": wavy(6, 0.2, 0.1, 0.05), "00003": wavy(400, 30.0, 10.0, 12.0),
              "00004": [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)], "00005": [(5, 5), (6, 6), (5, 5)]}
    b = spark.createDataFrame([(k, k, _ring(s), 4326) for k, s in shapes.items()] + [("00004", "x", _ring(shapes["00004"]), 4326)],
                              f"county_fips string, county_name string, {RING}, srid int")
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1.6, 2.2, (120, 2)))]
    pts += [(200, 1.0, 1.5), (201, 1.0, 1.0), (202, 0.5, 2.0), (203, 30.0, 10.0), (204, 0.5, 0.5), (204, 0.5, 0.5), (205, 0.2, 0.1)]
    points = spark.createDataFrame([*pts, (300, None, 1.0)], "station_id long, lng double, lat double")
    prepared = spatial.prepare_boundaries(b)
    got = sorted(map(tuple, spatial.points_in_polygons(points, prepared).collect()))
    every = points.join(prepared.select("county_fips", "ring")).where(
        geo.point_in_ring_strict(F.col("ring"), F.col("lng"), F.col("lat")))
    want = sorted(map(tuple, every.select("station_id", "county_fips").collect()))
    assert got == want and {c for _, c in got} >= {"00001", "00002", "00003", "00004"}
    assert spatial.points_in_polygons(points.limit(0), prepared).count() == 0
    assert spatial.points_in_polygons(points, prepared.limit(0)).count() == 0
