"""Mobility features (H06, E01-E04); E09 composes them in plans/pipeline.py.

H06 is the only trip-level step: one grouped aggregate of predicate
averages over the enriched trips.  Everything after it works on one row
per county.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.functions.bands import quantile_cut
from tessera.operators.spending import latest_population

# Fixed values that must equal the reference's results.
PEAK_HOURS = [7, 8, 17, 18]
NIGHT_HOURS = [22, 23, 0, 1, 2, 3, 4, 5]


def temporal_patterns(trips: DataFrame) -> DataFrame:
    """Per county share of peak-hour, weekend, night, summer and
    winter trips and |summer - winter|, by start time."""
    t = trips.where(F.col("county_fips").isNotNull())
    return t.groupBy("county_fips").agg(*temporal_aggregates())


def temporal_aggregates() -> list[Column]:
    """H06's aggregates, so that another pass over the trips can carry them."""
    ts = F.col("start_time")
    share = lambda cond: F.avg(cond.cast("double"))
    summer, winter = (share(temporal.season(F.month(ts)) == s) for s in ("Summer", "Winter"))
    return [share(F.hour(ts).isin(*PEAK_HOURS)).alias("peak_hour_ratio"),
            share(F.weekday(ts).isin(5, 6)).alias("weekend_ratio"),
            share(F.hour(ts).isin(*NIGHT_HOURS)).alias("night_trips_ratio"),
            summer.alias("summer_trips_ratio"), winter.alias("winter_trips_ratio"),
            F.abs(summer - winter).alias("seasonal_variation")]


def add_usage_patterns(df: DataFrame) -> DataFrame:
    """0/1 preference flags.  ``trip_duration_variability`` is the
    measured per-county standard deviation (the reference draws a random
    stand-in)."""
    if "member_ratio" not in df.columns:
        df = df.withColumn("member_ratio", F.try_divide(F.col("member_trips").cast("double"),
                                                        F.col("total_trips")))
    flag = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(c.cast("int"))
    return (df.withColumn("short_trip_preference", flag(F.col("avg_trip_duration_minutes") < 10))
            .withColumn("long_trip_preference", flag(F.col("avg_trip_duration_minutes") > 30))
            .withColumn("trip_duration_variability", F.col("std_trip_duration_minutes"))
            .withColumn("short_distance_preference", flag(F.col("avg_trip_distance_km") < 2))
            .withColumn("long_distance_preference", flag(F.col("avg_trip_distance_km") > 8))
            .withColumn("high_inter_county_mobility", flag(F.col("inter_county_ratio") > 0.1)))


def add_volume_intensity(df: DataFrame) -> DataFrame:
    """Estimated stations, density, F04 volume band, trips per station."""
    est = F.sqrt(F.col("total_trips") / 100.0)
    df = (df.withColumn("estimated_stations", est)
          .withColumn("station_density_per_sq_km", F.try_divide(F.col("estimated_stations"), F.col("area_sq_km"))))
    df = quantile_cut(df, "total_trips", (0.33, 0.67), out="trip_volume_category")
    return df.withColumn("trips_per_station",
                         F.try_divide(F.col("total_trips").cast("double"), F.col("estimated_stations")))


def add_per_capita_mobility(df: DataFrame, population: DataFrame) -> DataFrame:
    """Trips, member and casual trips per 1000 people (latest year);
    penetration = min(trips_per_capita / 10, 1)."""
    out = df.join(latest_population(population), "county_fips", "left")
    pc = lambda c: F.try_divide(F.col(c).cast("double"), F.col("population").cast("double")) * 1000
    out = (out.withColumn("trips_per_capita", pc("total_trips"))
           .withColumn("member_trips_per_capita", pc("member_trips"))
           .withColumn("casual_trips_per_capita", pc("casual_trips")))
    return out.withColumn("mobility_penetration_rate",
                          F.when(F.col("trips_per_capita").isNotNull(),
                                 F.least(F.col("trips_per_capita") / 10.0, F.lit(1.0))))


def create_mobility_features(mobility: DataFrame, enriched_trips: DataFrame | None,
                             population: DataFrame | None, temporal_shares: DataFrame | None = None) -> DataFrame:
    """H06 (left join) → E01 → E02 → E03; ``temporal_shares`` is H06's result, if it is at hand."""
    f = mobility
    if temporal_shares is not None:
        f = f.join(temporal_shares, "county_fips", "left")
    elif enriched_trips is not None:
        f = f.join(temporal_patterns(enriched_trips), "county_fips", "left")
    f = add_volume_intensity(add_usage_patterns(f))
    if population is not None:
        f = add_per_capita_mobility(f, population)
    return f
