"""Registered queries: geospatial operators, stations and county mobility."""

from __future__ import annotations

from tessera.oracle.views import with_
from tessera.plans.flagship import county_mobility
from tessera.plans.registry import register
from tessera.sources import views

H02_DOUBLES = (
    "avg_trip_duration_minutes", "median_trip_duration_minutes", "std_trip_duration_minutes",
    "avg_trip_distance_km", "median_trip_distance_km", "std_trip_distance_km",
    "avg_trip_speed_kmh", "median_trip_speed_kmh", "member_ratio", "inter_county_ratio",
    "area_sq_km", "centroid_lat", "centroid_lng", "trips_per_sq_km",
)


@register("h02_aggregate_trips_to_county_level",
          with_("county_mobility") + "SELECT * FROM county_mobility", H02_DOUBLES)
def h02(spark, d):
    """Flagship: per-county trips, duration, distance, speed, member and
    inter-county shares, with county metadata."""
    return county_mobility(views.trips(spark, d), views.boundaries(spark, d))
