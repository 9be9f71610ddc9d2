"""Trips → stations → counties → county mobility profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import spatial


def county_mobility(trips: DataFrame, boundaries: DataFrame) -> DataFrame:
    """G10 → G14 → G15 → G16 → H01 → J02 (aggregate_trips_to_county_level)."""
    prepared = spatial.prepare_boundaries(boundaries).persist()
    stations = spatial.extract_stations(trips)
    assigned = spatial.assign_stations(stations, prepared)
    station_map = spatial.station_county_map(assigned)
    enriched = spatial.add_trip_metrics(spatial.add_county_info(trips, station_map))
    agg = spatial.county_aggregation(enriched)
    return spatial.add_county_metadata(agg, prepared)


def enriched_trips(trips: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Trips with county columns and metrics (G15 + G16 output)."""
    prepared = spatial.prepare_boundaries(boundaries).persist()
    stations = spatial.extract_stations(trips)
    assigned = spatial.assign_stations(stations, prepared)
    station_map = spatial.station_county_map(assigned)
    return spatial.add_trip_metrics(spatial.add_county_info(trips, station_map))
