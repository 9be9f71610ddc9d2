"""Registry of the engine's queries and their DuckDB value oracles.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` plus, when SQL
can express it, an equivalent DuckDB statement over the same tables.
``finish`` gives every Spark result a comparison-friendly shape: DOUBLE
columns rounded (the oracle rounds the same columns) and integer columns
widened to BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.oracle.views import rounded


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple = field(default_factory=tuple)  # names, or (name, digits)
    digits: int = 6


REGISTRY: dict[str, Entry] = {}

# Oracle columns that DuckDB types as INTEGER / HUGEINT (year and month
# parts, sums of counts) where the Spark side returns BIGINT; the oracle
# wrapper casts them so both results carry the same types.
INT_CASTS = {
    'h09_county_spending_by_period': ('year', 'month'),
    'w01_lag_features': ('year', 'month'),
    'w02_rolling_mean_3': ('year', 'month'),
    'w07_calendar_keys': ('year', 'month'),
    'j05_semi_join_county_set': ('year', 'month'),
    'e01_usage_patterns': ('short_trip_preference', 'long_trip_preference', 'short_distance_preference', 'long_distance_preference', 'high_inter_county_mobility'),
    'e04_create_mobility_features': ('inter_county_trips', 'member_trips', 'casual_trips', 'short_trip_preference', 'long_trip_preference', 'short_distance_preference', 'long_distance_preference', 'high_inter_county_mobility'),
    'k09_cluster_profiles': ('cluster',),
    'k09_cluster_summary': ('cluster',),
    'k12_outlier_summary': ('n_outliers',),
    'g09_prepare_boundaries': ('srid',),
    'g11_station_trip_counts': ('trip_count',),
    'g14_assign_stations_to_counties': ('trip_count',),
    'n01_mobility_traits': ('cluster',),
    'n02_spending_traits': ('cluster',),
    'n03_temporal_traits': ('cluster',),
    'n05_cluster_characteristics': ('cluster',),
    'n04_determine_persona_type': ('cluster_id',),
    'n06_demographic_profile': ('cluster_id',),
    'n12_persona_narratives': ('cluster_id',),
    'o03_market_overview': ('total_population',),
    'h07_population_by_persona_type': ('population',),
    'd04_d05_d06_panels': ('total_population', 'high_effectiveness_count'),
    'd17_selected_persona_totals': ('selected_population',),
    'b19_spatial_validation': ('unassigned_stations', 'invalid_coordinates'),
    'b20_detect_outliers_iqr': ('year', 'month'),
    'b21_detect_outliers_zscore': ('year', 'month'),
    'b22_data_summary': ('null_count',),
    'h14_normalized_crosstab': ('cluster',),
    'h10_stations_per_county': ('total_station_trips',),
    'h11_county_mobility_summary': ('total_trips',),
    'h15_city_comparison': ('total_trips',),
    'a01_load_saved_data': ('n_nationkey', 'n_regionkey'),
    'a05_spending_for_counties': ('year', 'month'),
    'a07_population_for_counties': ('year',),
    'h01_perform_county_aggregation': ('inter_county_trips', 'member_trips', 'casual_trips'),
    'h02_aggregate_trips_to_county_level': ('inter_county_trips', 'member_trips', 'casual_trips'),
}



def _digit_map(doubles, digits: int) -> dict[str, int]:
    out = {}
    for d in doubles:
        if isinstance(d, tuple):
            out[d[0]] = d[1]
        else:
            out[d] = digits
    return out


def finish(df: DataFrame, digits: int = 6, per_col: dict[str, int] | None = None) -> DataFrame:
    per_col = per_col or {}
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), per_col.get(f.name, digits))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(key: str, sql: str | None = None, doubles: tuple = (),
             digits: int = 6):
    per_col = _digit_map(doubles, digits)

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir), digits, per_col)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[key] = Entry(run, sql, tuple(doubles), digits)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: rounded(e.sql, _digit_map(e.doubles, e.digits), INT_CASTS.get(k, ()))
            for k, e in REGISTRY.items() if e.sql is not None}


def _load_all() -> None:
    # Importing the catalogue modules fills REGISTRY.
    from tessera.plans import (  # noqa: F401
        catalog_cluster, catalog_features, catalog_fitted, catalog_geo, catalog_models, catalog_personas, catalog_quality,
        catalog_named, catalog_rollups, catalog_spatial)
