"""Stations, point-in-polygon assignment and trip enrichment.

Scale notes
-----------
* Trips are the only table that grows with the data.  They are scanned
  once to extract stations (G10+G11 share one pass with a map-side
  partial aggregate) and once to enrich them (G15).
* Stations and counties are dimension tables: their size is bounded by the
  number of physical stations / counties, checked before broadcasting.
* The point-in-polygon theta join becomes an equi-join on grid cells; only
  candidates in the same cell reach the ray-casting test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.stats import grouped_medians
from tessera.operators.neighbors import knn_join
from tessera.operators.rings import points_in_rings
from tessera.session import broadcast_if_bounded, cut_lineage


# ------------------------------------------------------------ boundaries
def prepare_boundaries(boundaries: DataFrame) -> DataFrame:
    """CRS default, bbox, areas and centroid per polygon.

    Missing SRID → 4326; 3857 rings are projected back to degrees; any
    other SRID is rejected by leaving the row out of the prepared table.
    """
    srid = F.coalesce(F.col("srid"), F.lit(4326))
    deg_ring = F.when(srid == 4326, F.col("ring")).when(
        srid == 3857,
        F.transform("ring", lambda p: F.struct(
            F.degrees(p["lng"] / geo.MERCATOR_RADIUS_M).alias("lng"),
            F.degrees(F.lit(2.0) * F.atan(F.exp(p["lat"] / geo.MERCATOR_RADIUS_M))
                      - F.lit(3.141592653589793 / 2)).alias("lat"))))
    b = boundaries.withColumn("ring", deg_ring).withColumn("srid", F.lit(4326)) \
        .where(F.col("ring").isNotNull())
    clat, clng = geo.ring_centroid("ring")
    return b.select(
        "county_fips", "county_name", "ring", "srid",
        F.array_min(F.transform("ring", lambda p: p["lng"])).alias("min_lng"),
        F.array_max(F.transform("ring", lambda p: p["lng"])).alias("max_lng"),
        F.array_min(F.transform("ring", lambda p: p["lat"])).alias("min_lat"),
        F.array_max(F.transform("ring", lambda p: p["lat"])).alias("max_lat"),
        geo.ring_area_spherical_km2("ring").alias("area_sq_km"),
        geo.ring_area_mercator_km2("ring").alias("area_sq_km_mercator"),
        clat.alias("centroid_lat"), clng.alias("centroid_lng"),
    )


# -------------------------------------------------------------- stations
def station_endpoints(trips: DataFrame) -> DataFrame:
    """Start and end stations of every trip as one UNION ALL stream."""
    ends = F.explode(F.array(
        F.struct(F.lit("start").alias("side"), F.col("start_station_id").alias("station_id"),
                 F.col("start_lat").alias("lat"), F.col("start_lng").alias("lng")),
        F.struct(F.lit("end").alias("side"), F.col("end_station_id").alias("station_id"),
                 F.col("end_lat").alias("lat"), F.col("end_lng").alias("lng"))))
    return trips.select(ends.alias("e")).select("e.*")


def extract_stations(trips: DataFrame) -> DataFrame:
    """G10 + G11: (station_id, lat, lng, trip_count).

    lat/lng = mean over the distinct (side, id, lat, lng) rows, as the
    reference averages the de-duplicated start and end lists; trip_count =
    starts + ends.  One pass over trips; the first aggregate is partial on
    the map side, so only distinct coordinate rows are shuffled.
    """
    e = station_endpoints(trips).where(F.col("station_id").isNotNull())
    distinct_rows = e.groupBy("side", "station_id", "lat", "lng").agg(
        F.count(F.lit(1)).alias("n"))
    return distinct_rows.groupBy("station_id").agg(
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
        F.sum("n").alias("trip_count"))


def station_trip_counts(trips: DataFrame) -> DataFrame:
    """G11 / S04 alone: starts + ends per station id."""
    return (station_endpoints(trips).where(F.col("station_id").isNotNull())
            .groupBy("station_id").agg(F.count(F.lit(1)).alias("trip_count")))


# ------------------------------------------------------- point in polygon
def points_in_polygons(points: DataFrame, prepared: DataFrame) -> DataFrame:
    """(station_id, county_fips) for strict containment.

    Boundary points match nothing, overlapping polygons give several rows.
    """
    return points_in_rings(points, prepared)


def nearest_centroid(points: DataFrame, prepared: DataFrame) -> DataFrame:
    """Nearest county centroid by planar degree distance;
    ties go to the smaller FIPS (first polygon in table order)."""
    # Counties are a bounded dimension; numbering them in one small
    # window gives the kNN join a numeric id that keeps FIPS order.
    codes = prepared.select("county_fips").distinct().withColumn(
        "tid", F.dense_rank().over(Window.orderBy("county_fips")).cast("long"))
    tg = prepared.join(codes, "county_fips").select(
        "tid", F.col("centroid_lng").alias("x"), F.col("centroid_lat").alias("y"))
    # ids of any type: real station ids are text
    pid = points.select(F.col("station_id").alias("pid"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    nn = knn_join(pid, tg, 1)
    return (nn.join(codes, "tid")
            .select(F.col("pid").alias("station_id"), "county_fips"))


def assign_stations(stations: DataFrame, prepared: DataFrame) -> DataFrame:
    """Stations with county_fips / county_name (+ assignment method).

    Left join of G12 matches; unmatched stations take G13's nearest
    centroid.  A station inside several polygons keeps several rows.
    """
    stations = stations.persist()
    inside = points_in_polygons(stations, prepared).persist()
    unmatched = stations.join(inside, "station_id", "left_anti")
    near = nearest_centroid(unmatched, prepared)
    assigned = (inside.withColumn("assignment", F.lit("within"))
                .unionByName(near.withColumn("assignment", F.lit("nearest_centroid"))))
    names = prepared.select("county_fips", "county_name")
    return (stations.join(assigned, "station_id", "left")
            .join(names, "county_fips", "left")
            .select("station_id", "lat", "lng", "trip_count", "county_fips", "county_name",
                    "assignment"))


def station_county_map(assigned: DataFrame) -> DataFrame:
    """One county per station; the last polygon wins on duplicates."""
    return (assigned.where(F.col("county_fips").isNotNull())
            .groupBy("station_id").agg(F.max("county_fips").alias("county_fips")))


# ---------------------------------------------------------- trip metrics
def add_county_info(trips: DataFrame, station_map: DataFrame) -> DataFrame:
    """start/end county by two lookups; county = start county;
    unmapped ends count as inter-county (NaN != NaN in the reference)."""
    m = broadcast_if_bounded(station_map.persist())
    s = m.select(F.col("station_id").alias("start_station_id"),
                 F.col("county_fips").alias("start_county_fips"))
    e = m.select(F.col("station_id").alias("end_station_id"),
                 F.col("county_fips").alias("end_county_fips"))
    t = trips.join(s, "start_station_id", "left").join(e, "end_station_id", "left")
    return t.withColumn("county_fips", F.col("start_county_fips")).withColumn(
        "is_inter_county",
        ~F.coalesce(F.col("start_county_fips") == F.col("end_county_fips"), F.lit(False)))


def add_trip_metrics(trips: DataFrame) -> DataFrame:
    """Duration (min), haversine distance (km), speed (km/h; ±inf → null)."""
    dur = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")) / 60.0
    return (trips.withColumn("trip_duration_minutes", dur)
            .withColumn("trip_distance_km",
                        geo.haversine_km("start_lat", "start_lng", "end_lat", "end_lng"))
            .withColumn("trip_speed_kmh",
                        F.try_divide(F.col("trip_distance_km"), F.col("trip_duration_minutes") / 60.0)))


def county_aggregation(trips: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Per-county trip statistics (null counties dropped as in pandas).

    One aggregate over the trips, partial on the map side, holds every count, mean and standard deviation and ``extra``
    aggregates of the caller (appended as columns).  Two passes find the three medians, the second only from the values of
    the histogram steps that hold them, so no per-trip row is shuffled or written.
    """
    t = trips.where(F.col("county_fips").isNotNull())
    values = {c: F.col(c).cast("double") for c in ("trip_duration_minutes", "trip_distance_km", "trip_speed_kmh")}
    stats = [fn(v).alias(f"{prefix}_{c}") for c, v in values.items() for prefix, fn in (("avg", F.avg), ("std", F.stddev_samp))]
    agg = cut_lineage(t.groupBy("county_fips").agg(
        F.count("trip_id").alias("total_trips"), *stats,
        F.count_if(F.coalesce(F.col("is_inter_county"), F.lit(False))).alias("inter_county_trips"),
        F.count_if(F.coalesce(F.col("member_type") == "member", F.lit(False))).alias("member_trips"),
        *extra))
    more = [c for c in agg.columns if c not in {
        "county_fips", "total_trips", "inter_county_trips", "member_trips", *[f"{p}_{v}" for v in values for p in ("avg", "std")]}]
    med = grouped_medians(t, ["county_fips"], {f"{c}_median": v for c, v in values.items()})
    return agg.join(med, "county_fips", "left").select(
        "county_fips", "total_trips",
        "avg_trip_duration_minutes", F.col("trip_duration_minutes_median").alias("median_trip_duration_minutes"),
        "std_trip_duration_minutes",
        "avg_trip_distance_km", F.col("trip_distance_km_median").alias("median_trip_distance_km"), "std_trip_distance_km",
        "avg_trip_speed_kmh", F.col("trip_speed_kmh_median").alias("median_trip_speed_kmh"),
        "inter_county_trips", "member_trips",
        (F.col("total_trips") - F.col("member_trips")).alias("casual_trips"),
        F.try_divide(F.col("member_trips").cast("double"), F.col("total_trips")).alias("member_ratio"),
        F.try_divide(F.col("inter_county_trips").cast("double"), F.col("total_trips"))
        .alias("inter_county_ratio"), *more)


def add_county_metadata(county_agg: DataFrame, prepared: DataFrame) -> DataFrame:
    """Name, area, centroid (broadcast left join) and trips per km²."""
    meta = prepared.select("county_fips", "county_name", "area_sq_km", "centroid_lat", "centroid_lng")
    return (county_agg.join(broadcast_if_bounded(meta.persist()), "county_fips", "left")
            .withColumn("trips_per_sq_km",
                        F.try_divide(F.col("total_trips").cast("double"), F.col("area_sq_km"))))
