"""DuckDB twins of the adapter views, as CTE fragments.

The value oracle runs each ``oracle_sql()`` statement in DuckDB over the
same Parquet tables.  These fragments restate FIXTURES.md §3 in DuckDB SQL;
``with_(...)`` assembles the CTEs a statement needs, in dependency order.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (deps, sql)


def _order(names, seen=None, out=None):
    seen = set() if seen is None else seen
    out = [] if out is None else out
    for n in names:
        if n in seen:
            continue
        deps, _ = CTES[n]
        _order(deps, seen, out)
        seen.add(n)
        out.append(n)
    return out


def with_(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named CTEs and their deps."""
    parts = [f"{n} AS ({CTES[n][1]})" for n in _order(names)]
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(sql: str, cols: dict[str, int], bigints: tuple[str, ...] = ()) -> str:
    """Wrap ``sql`` so the named DOUBLE columns are rounded (name → digits)
    and the named integer columns are BIGINT, the types the Spark side
    returns."""
    rep = [f"round(CAST({c} AS DOUBLE), {d}) AS {c}" for c, d in cols.items()]
    rep += [f"CAST({c} AS BIGINT) AS {c}" for c in bigints]
    if not rep:
        return sql
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({sql}) AS _q"


def slat(x: str) -> str:
    return f"(40.005 + (({x}) * 37 % 520) / 100)"


def slng(x: str) -> str:
    return f"(-89.995 + (({x}) * 91 % 510) / 100)"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (f"(2.0 * asin(least(1.0, sqrt(power(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2}))"
            f" * power(sin((radians({lng2}) - radians({lng1})) / 2), 2)))) * 6371.0)")


_END_ID = "((l.l_suppkey + l.l_partkey) % 97)"
_TRIP_COLS = f"""
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS trip_id,
    {{start}} AS start_time,
    {{end}} AS end_time,
    l.l_suppkey AS start_station_id,
    {_END_ID} AS end_station_id,
    {slat('l.l_suppkey')} AS start_lat,
    {slng('l.l_suppkey')} AS start_lng,
    {slat(_END_ID)} AS end_lat,
    {slng(_END_ID)} AS end_lng,
    CASE WHEN l.l_linestatus = 'O' THEN 'member' ELSE 'casual' END AS member_type
"""
_OFFSET = "CAST((l.l_partkey % 24) * 60 + l.l_suppkey % 60 AS BIGINT)"

cte("trips", "SELECT " + _TRIP_COLS.format(
    start=f"o.o_orderdate + to_minutes({_OFFSET})",
    end=f"o.o_orderdate + to_minutes({_OFFSET} + CAST(l.l_quantity AS BIGINT))",
) + " FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")

cte("trips_dirty", "SELECT " + _TRIP_COLS.format(start="o.o_orderdate", end="l.l_shipdate")
    + " FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")

cte("spending", """
SELECT county_fips, year, month, category, spending_amount, make_timestamp(year, month, 1, 0, 0, 0) AS date
FROM (SELECT lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS county_fips,
             CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(month(o.o_orderdate) AS INTEGER) AS month,
             CASE WHEN p.p_type LIKE '%STANDARD%' THEN 'restaurants'
                  WHEN p.p_type LIKE '%PROMO%' THEN 'retail'
                  WHEN p.p_type LIKE '%ECONOMY%' THEN 'grocery'
                  WHEN p.p_type LIKE '%MEDIUM%' THEN 'entertainment'
                  WHEN p.p_type LIKE '%SMALL%' THEN 'transportation'
                  WHEN p.p_type LIKE '%LARGE%' THEN 'healthcare' END AS category,
             CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l.l_discount AS DECIMAL(18,2)))
                  AS DOUBLE) AS spending_amount
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
      GROUP BY 1, 2, 3, 4) AS s""")


# Unit squares; areas mirror the engine's edge sum term by term.
_R2 = "40589641.0"
cte("bnd", f"""
SELECT county_fips, county_name, region_key, x0, y0, x0 + 1 AS x1, y0 + 1 AS y1,
       x0 + 0.5 AS centroid_lng, y0 + 0.5 AS centroid_lat,
       abs((0.0 + radians(1.0) * (2.0 + sin(radians(y0)) + sin(radians(y0))) + 0.0)
           + radians(-1.0) * (2.0 + sin(radians(y0 + 1)) + sin(radians(y0 + 1))) + 0.0)
         / 2.0 * {_R2} AS area_sq_km
FROM (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_fips, n_name AS county_name,
             n_regionkey AS region_key,
             CAST(-90 + n_nationkey % 5 AS DOUBLE) AS x0,
             CAST(40 + floor(n_nationkey / 5) AS DOUBLE) AS y0
      FROM nation) AS b""")

cte("station_rows", """
SELECT side, station_id, lat, lng, count(*) AS n FROM (
  SELECT 'start' AS side, start_station_id AS station_id, start_lat AS lat, start_lng AS lng FROM trips
  UNION ALL
  SELECT 'end', end_station_id, end_lat, end_lng FROM trips) AS e
WHERE station_id IS NOT NULL GROUP BY side, station_id, lat, lng""", ("trips",))

cte("stations", """
SELECT station_id, avg(lat) AS lat, avg(lng) AS lng, sum(n) AS trip_count
FROM station_rows GROUP BY station_id""", ("station_rows",))

cte("inside", """
SELECT s.station_id, b.county_fips FROM stations s JOIN bnd b
  ON s.lng > b.x0 AND s.lng < b.x1 AND s.lat > b.y0 AND s.lat < b.y1""", ("stations", "bnd"))

cte("nearest", """
SELECT s.station_id,
       first(b.county_fips ORDER BY sqrt(power(b.centroid_lng - s.lng, 2) + power(b.centroid_lat - s.lat, 2)),
             b.county_fips) AS county_fips
FROM stations s, bnd b
WHERE s.station_id NOT IN (SELECT station_id FROM inside)
GROUP BY s.station_id""", ("stations", "bnd", "inside"))

cte("assigned", """
SELECT s.station_id, s.lat, s.lng, s.trip_count, a.county_fips, b.county_name, a.assignment
FROM stations s
LEFT JOIN (SELECT station_id, county_fips, 'within' AS assignment FROM inside
           UNION ALL SELECT station_id, county_fips, 'nearest_centroid' FROM nearest) a
  ON s.station_id = a.station_id
LEFT JOIN bnd b ON a.county_fips = b.county_fips""", ("stations", "inside", "nearest", "bnd"))

cte("station_map", """
SELECT station_id, max(county_fips) AS county_fips FROM assigned
WHERE county_fips IS NOT NULL GROUP BY station_id""", ("assigned",))

cte("trips_enriched", f"""
SELECT t.*, sm.county_fips AS start_county_fips, em.county_fips AS end_county_fips,
       sm.county_fips AS county_fips,
       NOT coalesce(sm.county_fips = em.county_fips, false) AS is_inter_county,
       date_diff('second', t.start_time, t.end_time) / CAST(60.0 AS DOUBLE) AS trip_duration_minutes,
       {haversine('t.start_lat', 't.start_lng', 't.end_lat', 't.end_lng')} AS trip_distance_km,
       {haversine('t.start_lat', 't.start_lng', 't.end_lat', 't.end_lng')}
         / nullif(date_diff('second', t.start_time, t.end_time) / CAST(60.0 AS DOUBLE) / CAST(60.0 AS DOUBLE), 0)
         AS trip_speed_kmh
FROM trips t
LEFT JOIN station_map sm ON t.start_station_id = sm.station_id
LEFT JOIN station_map em ON t.end_station_id = em.station_id""", ("trips", "station_map"))

cte("county_agg", """
SELECT county_fips,
       count(trip_id) AS total_trips,
       avg(trip_duration_minutes) AS avg_trip_duration_minutes,
       median(trip_duration_minutes) AS median_trip_duration_minutes,
       stddev_samp(trip_duration_minutes) AS std_trip_duration_minutes,
       avg(trip_distance_km) AS avg_trip_distance_km,
       median(trip_distance_km) AS median_trip_distance_km,
       stddev_samp(trip_distance_km) AS std_trip_distance_km,
       avg(trip_speed_kmh) AS avg_trip_speed_kmh,
       median(trip_speed_kmh) AS median_trip_speed_kmh,
       count_if(is_inter_county) AS inter_county_trips,
       count_if(member_type = 'member') AS member_trips,
       count(trip_id) - count_if(member_type = 'member') AS casual_trips,
       count_if(member_type = 'member') / nullif(count(trip_id), 0) AS member_ratio,
       count_if(is_inter_county) / nullif(count(trip_id), 0) AS inter_county_ratio
FROM trips_enriched WHERE county_fips IS NOT NULL GROUP BY county_fips""", ("trips_enriched",))

cte("county_mobility", """
SELECT a.*, b.county_name, b.area_sq_km, b.centroid_lat, b.centroid_lng,
       a.total_trips / nullif(b.area_sq_km, 0) AS trips_per_sq_km
FROM county_agg a LEFT JOIN bnd b ON a.county_fips = b.county_fips""", ("county_agg", "bnd"))
