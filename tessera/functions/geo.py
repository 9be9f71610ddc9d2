"""Geographic column expressions.

All of them are plain Catalyst expressions, so they stay inside
whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's results.
EARTH_RADIUS_KM = 6371.0          # haversine and destination point
MERCATOR_RADIUS_M = 6378137.0     # EPSG:3857 sphere
COMPASS_POINTS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
DISTANCE_BANDS = [(1.0, "Short"), (5.0, "Medium"), (15.0, "Long")]  # else "Very Long"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; asin argument clamped to 1."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a))) * F.lit(EARTH_RADIUS_KM)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def compass_direction(bearing) -> Column:
    """8-way compass; half-even rounding as in Python's ``round``."""
    idx = F.pmod(F.bround(_c(bearing) / 45.0, 0).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(p) for p in COMPASS_POINTS]), idx + 1)


def distance_category(dist) -> Column:
    """Short / Medium / Long / Very Long."""
    d = _c(dist)
    expr = None
    for bound, label in DISTANCE_BANDS:
        expr = (F.when(d < bound, label) if expr is None else expr.when(d < bound, label))
    return expr.otherwise("Very Long")


def destination_point(lat, lng, dist_km, bearing) -> tuple[Column, Column]:
    """Point reached from (lat, lng) after ``dist_km`` on ``bearing``."""
    p1, l1 = F.radians(_c(lat)), F.radians(_c(lng))
    b = F.radians(_c(bearing))
    ad = _c(dist_km) / F.lit(EARTH_RADIUS_KM)
    p2 = F.asin(F.sin(p1) * F.cos(ad) + F.cos(p1) * F.sin(ad) * F.cos(b))
    l2 = l1 + F.atan2(F.sin(b) * F.sin(ad) * F.cos(p1), F.cos(ad) - F.sin(p1) * F.sin(p2))
    return F.degrees(p2), F.degrees(l2)


# ---------------------------------------------------------------- polygons
# A ring is ARRAY<STRUCT<lng DOUBLE, lat DOUBLE>>, closed (first == last).

def _edges_sum(ring: Column, term) -> Column:
    """Sum ``term(p_i, p_{i+1})`` over the edges of a closed ring."""
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.when(n > 1, term(F.try_element_at(ring, i), F.try_element_at(ring, i + 1)))
        .otherwise(F.lit(0.0)),
    )


def _merc_x(p):
    return F.radians(p["lng"]) * F.lit(MERCATOR_RADIUS_M)


def _merc_y(p):
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["lat"]) / 2)) * F.lit(MERCATOR_RADIUS_M)


def ring_area_mercator_km2(ring) -> Column:
    """G07 as the reference computes it: planar area in EPSG:3857, km²."""
    r = _c(ring)
    s = _edges_sum(r, lambda a, b: _merc_x(a) * _merc_y(b) - _merc_x(b) * _merc_y(a))
    return F.abs(s) / 2.0 / 1e6


def ring_area_spherical_km2(ring) -> Column:
    """G07 corrected: area on the sphere (exact for lat/lng rectangles)."""
    r = _c(ring)
    s = _edges_sum(
        r,
        lambda a, b: F.radians(b["lng"] - a["lng"])
        * (F.lit(2.0) + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))),
    )
    return F.abs(s) / 2.0 * F.lit(EARTH_RADIUS_KM * EARTH_RADIUS_KM)


def ring_centroid(ring) -> tuple[Column, Column]:
    """Planar polygon centroid in degrees (lat, lng)."""
    r = _c(ring)
    cross = lambda a, b: a["lng"] * b["lat"] - b["lng"] * a["lat"]
    a2 = _edges_sum(r, cross)
    cx = _edges_sum(r, lambda a, b: (a["lng"] + b["lng"]) * cross(a, b))
    cy = _edges_sum(r, lambda a, b: (a["lat"] + b["lat"]) * cross(a, b))
    return F.try_divide(cy, 3.0 * a2), F.try_divide(cx, 3.0 * a2)


def point_in_ring_strict(ring, lng, lat) -> Column:
    """True when (lng, lat) is strictly inside the ring (boundary excluded).

    Ray casting: count edges with (y1 > py) != (y2 > py) whose crossing lies
    right of the point; odd = inside.  Points on an edge return false.
    """
    r, px, py = _c(ring), _c(lng), _c(lat)
    n = F.size(r)
    idx = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))

    def crossing(i):
        a, b = F.try_element_at(r, i), F.try_element_at(r, i + 1)
        straddles = (a["lat"] > py) != (b["lat"] > py)
        x_at = a["lng"] + F.try_divide((py - a["lat"]) * (b["lng"] - a["lng"]), b["lat"] - a["lat"])
        return F.when(straddles & F.coalesce(px < x_at, F.lit(False)), F.lit(1)).otherwise(F.lit(0))

    def on_edge(i):
        a, b = F.try_element_at(r, i), F.try_element_at(r, i + 1)
        cross = (b["lng"] - a["lng"]) * (py - a["lat"]) - (b["lat"] - a["lat"]) * (px - a["lng"])
        within = (
            (px >= F.least(a["lng"], b["lng"])) & (px <= F.greatest(a["lng"], b["lng"]))
            & (py >= F.least(a["lat"], b["lat"])) & (py <= F.greatest(a["lat"], b["lat"]))
        )
        return (cross == 0) & within

    parity = F.aggregate(idx, F.lit(0), lambda acc, i: acc + F.when(n > 3, crossing(i)).otherwise(0))
    touches = F.exists(idx, lambda i: F.coalesce(on_edge(i), F.lit(False)))
    return (F.pmod(parity, F.lit(2)) == 1) & ~touches
