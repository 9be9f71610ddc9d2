"""Registered queries: geometry, scalar functions, sets and joins
(G01-G16, F01-F03, W05, S01-S04, J03, J06-J08, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo, temporal
from tessera.operators import spatial
from tessera.operators.neighbors import knn_join
from tessera.oracle.views import cte, haversine, with_
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import views

_BEARING = ("((degrees(atan2(sin(radians(end_lng) - radians(start_lng)) * cos(radians(end_lat)), "
            "cos(radians(start_lat)) * sin(radians(end_lat)) - sin(radians(start_lat)) * cos(radians(end_lat)) "
            "* cos(radians(end_lng) - radians(start_lng)))) + 360.0) % 360.0)")
_DIST = haversine("start_lat", "start_lng", "end_lat", "end_lng")
_DIR = (f"(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(((CAST(round_even({_BEARING} / 45.0, 0) AS BIGINT) "
        f"% 8) + 8) % 8 AS BIGINT) + 1]")
_DCAT = (f"CASE WHEN {_DIST} < 1.0 THEN 'Short' WHEN {_DIST} < 5.0 THEN 'Medium' "
         f"WHEN {_DIST} < 15.0 THEN 'Long' ELSE 'Very Long' END")


def _trip_geo(spark, d):
    return views.trips(spark, d).select("trip_id", "start_station_id", "end_station_id",
                                        "start_lat", "start_lng", "end_lat", "end_lng")


@register("g01_haversine_distance", with_("trips") + f"""
SELECT trip_id, start_station_id, end_station_id, {_DIST} AS trip_distance_km FROM trips""",
          ("trip_distance_km",))
def g01(spark, d):
    t = _trip_geo(spark, d)
    return t.select("trip_id", "start_station_id", "end_station_id",
                    geo.haversine_km("start_lat", "start_lng", "end_lat", "end_lng").alias("trip_distance_km"))


@register("g02_calculate_bearing", with_("trips") + f"""
SELECT trip_id, start_station_id, end_station_id, {_BEARING} AS trip_bearing FROM trips""", ("trip_bearing",))
def g02(spark, d):
    t = _trip_geo(spark, d)
    return t.select("trip_id", "start_station_id", "end_station_id",
                    geo.bearing_deg("start_lat", "start_lng", "end_lat", "end_lng").alias("trip_bearing"))


@register("g03_bearing_to_direction", with_("trips") + f"""
SELECT trip_id, start_station_id, end_station_id, {_DIR} AS trip_direction FROM trips""")
def g03(spark, d):
    t = _trip_geo(spark, d)
    b = geo.bearing_deg("start_lat", "start_lng", "end_lat", "end_lng")
    return t.select("trip_id", "start_station_id", "end_station_id",
                    geo.compass_direction(b).alias("trip_direction"))


@register("g04_categorize_distance", with_("trips") + f"""
SELECT trip_id, start_station_id, end_station_id, {_DCAT} AS distance_category FROM trips""")
def g04(spark, d):
    t = _trip_geo(spark, d)
    dist = geo.haversine_km("start_lat", "start_lng", "end_lat", "end_lng")
    return t.select("trip_id", "start_station_id", "end_station_id",
                    geo.distance_category(dist).alias("distance_category"))


def add_spatial_features(df):
    """Distance, bearing, direction and distance band as columns."""
    dist = geo.haversine_km("start_lat", "start_lng", "end_lat", "end_lng")
    bearing = geo.bearing_deg("start_lat", "start_lng", "end_lat", "end_lng")
    return (df.withColumn("trip_distance_km", dist).withColumn("trip_bearing", bearing)
            .withColumn("trip_direction", geo.compass_direction(F.col("trip_bearing")))
            .withColumn("distance_category", geo.distance_category(F.col("trip_distance_km"))))


@register("g05_add_spatial_features", with_("trips") + f"""
SELECT trip_id, start_station_id, end_station_id, {_DIST} AS trip_distance_km, {_BEARING} AS trip_bearing,
       {_DIR} AS trip_direction, {_DCAT} AS distance_category FROM trips""", ("trip_distance_km", "trip_bearing"))
def g05(spark, d):
    return add_spatial_features(_trip_geo(spark, d)).drop("start_lat", "start_lng", "end_lat", "end_lng")


@register("g06_offset_coordinates", with_("trips") + f"""
SELECT trip_id, start_station_id, end_station_id,
       degrees(asin(sin(radians(start_lat)) * cos(({_DIST}) / 6371.0)
            + cos(radians(start_lat)) * sin(({_DIST}) / 6371.0) * cos(radians({_BEARING})))) AS dest_lat,
       degrees(radians(start_lng) + atan2(sin(radians({_BEARING})) * sin(({_DIST}) / 6371.0) * cos(radians(start_lat)),
            cos(({_DIST}) / 6371.0) - sin(radians(start_lat)) * sin(asin(sin(radians(start_lat))
            * cos(({_DIST}) / 6371.0) + cos(radians(start_lat)) * sin(({_DIST}) / 6371.0)
            * cos(radians({_BEARING})))))) AS dest_lng
FROM trips""", ("dest_lat", "dest_lng"), digits=5)
def g06(spark, d):
    """Destination point from each trip's start, distance and bearing
    (lands on the end station)."""
    t = _trip_geo(spark, d)
    dist = geo.haversine_km("start_lat", "start_lng", "end_lat", "end_lng")
    b = geo.bearing_deg("start_lat", "start_lng", "end_lat", "end_lng")
    lat, lng = geo.destination_point(F.col("start_lat"), F.col("start_lng"), dist, b)
    return t.select("trip_id", "start_station_id", "end_station_id", lat.alias("dest_lat"),
                    lng.alias("dest_lng"))


def _merc_sql() -> str:
    def x(v):
        return f"(radians({v}) * 6378137.0)"

    def y(v):
        return f"(ln(tan({3.141592653589793 / 4!r} + radians({v}) / 2)) * 6378137.0)"
    pts = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    acc = "0.0"
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        acc = f"({acc} + ({x(ax)} * {y(by)} - {x(bx)} * {y(ay)}))"
    return f"abs({acc}) / 2.0 / 1000000.0"


cte("bnd_prepared", f"""
SELECT county_fips, county_name, 4326 AS srid, x0 AS min_lng, x1 AS max_lng, y0 AS min_lat, y1 AS max_lat,
       area_sq_km, {_merc_sql()} AS area_sq_km_mercator, centroid_lat, centroid_lng FROM bnd""", ("bnd",))


@register("g07_boundary_area", with_("bnd_prepared") + """
SELECT county_fips, area_sq_km, area_sq_km_mercator FROM bnd_prepared""",
          ("area_sq_km", "area_sq_km_mercator"), digits=4)
def g07(spark, d):
    p = spatial.prepare_boundaries(views.boundaries(spark, d))
    return p.select("county_fips", "area_sq_km", "area_sq_km_mercator")


@register("g08_boundary_centroid", with_("bnd_prepared") + """
SELECT county_fips, centroid_lat, centroid_lng FROM bnd_prepared""", ("centroid_lat", "centroid_lng"))
def g08(spark, d):
    p = spatial.prepare_boundaries(views.boundaries(spark, d))
    return p.select("county_fips", "centroid_lat", "centroid_lng")


@register("g09_prepare_boundaries", with_("bnd_prepared") + """
SELECT county_fips, county_name, srid, min_lng, max_lng, min_lat, max_lat FROM bnd_prepared""",
          ("min_lng", "max_lng", "min_lat", "max_lat"))
def g09(spark, d):
    """CRS default (missing → 4326) and bounding boxes."""
    b = views.boundaries(spark, d).withColumn("srid", F.lit(None).cast("int"))
    p = spatial.prepare_boundaries(b)
    return p.select("county_fips", "county_name", "srid", "min_lng", "max_lng", "min_lat", "max_lat")


@register("g10_extract_stations", with_("stations") + "SELECT station_id, lat, lng FROM stations", ("lat", "lng"))
def g10(spark, d):
    return spatial.extract_stations(views.trips(spark, d)).select("station_id", "lat", "lng")


@register("g11_station_trip_counts", with_("stations") + "SELECT station_id, trip_count FROM stations")
def g11(spark, d):
    return spatial.station_trip_counts(views.trips(spark, d))


@register("g12_point_in_polygon", with_("inside") + "SELECT station_id, county_fips FROM inside")
def g12(spark, d):
    prepared = spatial.prepare_boundaries(views.boundaries(spark, d))
    st = spatial.extract_stations(views.trips(spark, d))
    return spatial.points_in_polygons(st, prepared)


@register("g13_assign_nearest_county", with_("nearest") + "SELECT station_id, county_fips FROM nearest")
def g13(spark, d):
    prepared = context(spark, d).prepared()
    st = spatial.extract_stations(views.trips(spark, d)).persist()
    inside = spatial.points_in_polygons(st, prepared)
    return spatial.nearest_centroid(st.join(inside, "station_id", "left_anti"), prepared)


@register("g14_assign_stations_to_counties", with_("assigned") + "SELECT * FROM assigned", ("lat", "lng"))
def g14(spark, d):
    prepared = context(spark, d).prepared()
    st = spatial.extract_stations(views.trips(spark, d))
    return spatial.assign_stations(st, prepared)


@register("g15_add_county_info_to_trips", with_("trips_enriched") + """
SELECT trip_id, start_station_id, end_station_id, start_county_fips, end_county_fips, county_fips,
       is_inter_county FROM trips_enriched""")
def g15(spark, d):
    return context(spark, d).enriched_trips().select(
        "trip_id", "start_station_id", "end_station_id", "start_county_fips", "end_county_fips",
        "county_fips", "is_inter_county")


@register("g16_trip_metrics", with_("trips_enriched") + """
SELECT trip_id, start_station_id, end_station_id, trip_duration_minutes, trip_distance_km, trip_speed_kmh
FROM trips_enriched""", ("trip_duration_minutes", "trip_distance_km", "trip_speed_kmh"))
def g16(spark, d):
    return spatial.add_trip_metrics(views.trips(spark, d)).select(
        "trip_id", "start_station_id", "end_station_id", "trip_duration_minutes", "trip_distance_km",
        "trip_speed_kmh")


@register("j03_lookup_join_station_map", with_("station_map") + "SELECT * FROM station_map")
def j03(spark, d):
    prepared = context(spark, d).prepared()
    return spatial.station_county_map(context(spark, d).assigned())


@register("j08_knn_self_join", with_("stations") + """
SELECT station_id, neighbor_id, dist, rank FROM (
  SELECT a.station_id, b.station_id AS neighbor_id,
         sqrt(power(b.lng - a.lng, 2) + power(b.lat - a.lat, 2)) AS dist,
         CAST(row_number() OVER (PARTITION BY a.station_id
              ORDER BY sqrt(power(b.lng - a.lng, 2) + power(b.lat - a.lat, 2)), b.station_id) AS BIGINT) AS rank
  FROM stations a JOIN stations b ON a.station_id <> b.station_id) AS x
WHERE rank <= 3""", ("dist",))
def j08(spark, d):
    """k = 3 nearest stations of every station (self excluded); exact,
    cell-bucketed, no pair enumeration."""
    st = spatial.extract_stations(views.trips(spark, d)).persist()
    pts = st.select(F.col("station_id").alias("pid"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    tg = st.select(F.col("station_id").alias("tid"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    nn = knn_join(pts, tg, 3, exclude_self=True)
    return nn.select(F.col("pid").alias("station_id"), F.col("tid").alias("neighbor_id"), "dist", "rank")


@register("j11_counties_without_stations", with_("bnd", "assigned") + """
SELECT county_fips, county_name FROM bnd
WHERE county_fips NOT IN (SELECT county_fips FROM assigned WHERE county_fips IS NOT NULL)""")
def j11(spark, d):
    prepared = context(spark, d).prepared()
    a = context(spark, d).assigned().where(F.col("county_fips").isNotNull())
    return prepared.select("county_fips", "county_name").join(a.select("county_fips"), "county_fips", "left_anti")


@register("s01_union_all_endpoints", with_("trips") + """
SELECT side, station_id, count(*) AS n FROM (
  SELECT 'start' AS side, start_station_id AS station_id FROM trips
  UNION ALL SELECT 'end', end_station_id FROM trips) AS e GROUP BY side, station_id""")
def s01(spark, d):
    e = spatial.station_endpoints(views.trips(spark, d))
    return e.groupBy("side", "station_id").agg(F.count(F.lit(1)).alias("n"))


@register("s02_distinct_station_rows", with_("station_rows") + """
SELECT side, station_id, lat, lng FROM station_rows""", ("lat", "lng"))
def s02(spark, d):
    e = spatial.station_endpoints(views.trips(spark, d))
    return e.select("side", "station_id", "lat", "lng").distinct()


@register("s03_set_difference", with_("trips") + """
SELECT start_station_id AS station_id FROM trips EXCEPT SELECT end_station_id FROM trips""")
def s03(spark, d):
    """Stations that trips start from but never end at."""
    t = views.trips(spark, d)
    return t.select(F.col("start_station_id").alias("station_id")).subtract(
        t.select(F.col("end_station_id").alias("station_id")))


@register("s04_set_sum_with_fill", with_("trips") + """
SELECT coalesce(s.station_id, e.station_id) AS station_id,
       coalesce(s.n, 0) AS start_count, coalesce(e.n, 0) AS end_count,
       coalesce(s.n, 0) + coalesce(e.n, 0) AS trip_count
FROM (SELECT start_station_id AS station_id, count(*) AS n FROM trips GROUP BY 1) s
FULL OUTER JOIN (SELECT end_station_id AS station_id, count(*) AS n FROM trips GROUP BY 1) e
  ON s.station_id = e.station_id""")
def s04(spark, d):
    """Start and end counts added per station, missing side as 0 (one
    aggregate over the UNION ALL instead of a full outer join)."""
    e = spatial.station_endpoints(views.trips(spark, d))
    return e.groupBy("station_id").agg(
        F.count_if(F.col("side") == "start").alias("start_count"),
        F.count_if(F.col("side") == "end").alias("end_count"),
        F.count(F.lit(1)).alias("trip_count"))


_SEASON_SQL = ("CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring' "
               "WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END")
_PERIOD_SQL = ("CASE WHEN hour(ts) >= 5 AND hour(ts) < 12 THEN 'Morning' WHEN hour(ts) >= 12 AND hour(ts) < 17 "
               "THEN 'Afternoon' WHEN hour(ts) >= 17 AND hour(ts) < 21 THEN 'Evening' ELSE 'Night' END")


@register("f01_add_temporal_features", f"""
SELECT event_id, ts, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
       CAST(month(ts) AS BIGINT) AS month, CAST(year(ts) AS BIGINT) AS year,
       CAST(dayofyear(ts) AS BIGINT) AS day_of_year, CAST(weekofyear(ts) AS BIGINT) AS week_of_year,
       isodow(ts) IN (6, 7) AS is_weekend, {_SEASON_SQL} AS season, {_PERIOD_SQL} AS time_period
FROM events""")
def f01(spark, d):
    e = views.events(spark, d).select("event_id", "ts")
    return temporal.add_temporal_features(e, "ts")


@register("f02_season", f"SELECT event_id, {_SEASON_SQL} AS season FROM events")
def f02(spark, d):
    return views.events(spark, d).select("event_id", temporal.season(F.month("ts")).alias("season"))


@register("f03_time_period", f"SELECT event_id, {_PERIOD_SQL} AS time_period FROM events")
def f03(spark, d):
    return views.events(spark, d).select("event_id", temporal.time_period(F.hour("ts")).alias("time_period"))


@register("w05_create_time_windows", """
SELECT event_id, ts, date_trunc('hour', ts) AS time_window FROM events""")
def w05(spark, d):
    e = views.events(spark, d).select("event_id", "ts")
    return e.withColumn("time_window", temporal.time_window("ts", "1 hour"))


@register("w05_stream_hourly_windows", """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, avg(value) AS avg_value
FROM events GROUP BY 1, 2""", ("avg_value",))
def w05s(spark, d):
    """W05 as Structured Streaming: sums by hourly window of each events file,
    run with availableNow and added up; equals the batch aggregate."""
    import uuid

    from tessera.streaming.windows import run_hourly_stream, stream_paths
    out, ck = stream_paths(spark, "w05-" + uuid.uuid4().hex[:8])
    return run_hourly_stream(spark, f"{d.rstrip('/')}/events*.parquet", out, ck)
