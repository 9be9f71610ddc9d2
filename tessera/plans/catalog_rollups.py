"""Registered queries: privacy and bias (V01-V06), county and station
rollups (H10, H11, H13-H16, D11-D15, T01, T09) and sources (A01, A04-A08,
A15)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.bands import equal_width_cut
from tessera.operators import privacy
from tessera.oracle.views import cte, with_
from tessera.plans import catalog_cluster as CC
from tessera.plans import catalog_personas as CP
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import io, views

COUNTY_SET = ["00001", "00002", "00003", "00010"]
_SET_SQL = "(" + ", ".join(f"'{c}'" for c in COUNTY_SET) + ")"


def _band_sql(x: str, src: str) -> str:
    lo = f"(SELECT min(CAST({x} AS DOUBLE)) FROM {src})"
    hi = f"(SELECT max(CAST({x} AS DOUBLE)) FROM {src})"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {lo} + ({hi} - {lo}) / 3.0 THEN 'Low' "
            f"WHEN {x} <= {lo} + ({hi} - {lo}) * 2.0 / 3.0 THEN 'Medium' ELSE 'High' END")


# the columns of the views that the twin reads; the queries take theirs from the frames
_SCANNED = {"trips": ["trip_id", "start_time", "end_time", "start_station_id", "end_station_id", "start_lat", "start_lng",
                      "end_lat", "end_lng", "member_type"],
            "spending": ["county_fips", "year", "month", "category", "spending_amount"],
            "population": ["county_fips", "year", "population"]}


def identifier_sql(*tables: str) -> str:
    """DuckDB twin of the identifier scan over some tables."""
    def flag(column, patterns):
        return " OR ".join(f"contains('{column}', '{p}')" for p in patterns)

    return with_(*tables) + " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, '{c}' AS column_name, {flag(c, privacy.DIRECT_ID_PATTERNS)} AS direct_identifier, "
        f"{flag(c, privacy.QUASI_ID_PATTERNS)} AS quasi_identifier, count({c}) AS n_values, " + ", ".join(
            f"CAST(count_if(coalesce(regexp_matches(CAST({c} AS VARCHAR), '{p}'), false)) AS BIGINT) AS {n}"
            for n, p in privacy.VALUE_PATTERNS.items()) + f" FROM {t}" for t in tables for c in _SCANNED[t])


@register("v01_identifier_scan", identifier_sql("trips"))
def v01(spark, d):
    """Names and values of all columns of the trips."""
    return privacy.identifier_scan({"trips": context(spark, d).trips()})


@register("v02_k_anonymity", with_("trips_enriched") + """
SELECT min(n) AS k_anonymity_level, count(*) AS groups, min(n) < 5 AS needs_aggregation
FROM (SELECT county_fips, count(*) AS n FROM trips_enriched GROUP BY county_fips) AS g""")
def v02(spark, d):
    return privacy.k_anonymity(context(spark, d).enriched_trips())


cte("income_by_county", """
SELECT b.county_fips, d.median_income FROM bnd b LEFT JOIN demographics d ON b.county_fips = d.county_fips""",
    ("bnd", "demographics"))
cte("income_band", f"""
SELECT county_fips, {_band_sql('median_income', 'income_by_county')} AS band FROM income_by_county""",
    ("income_by_county",))
cte("parity", """
SELECT g.cluster, g.band, coalesce(c.n, 0) / t.band_n AS share FROM
  (SELECT DISTINCT l.cluster, b.band FROM labels l, (VALUES ('Low'), ('Medium'), ('High')) AS b(band)) g
  JOIN (SELECT x.band, count(*) AS band_n FROM income_band x JOIN labels l ON x.county_fips = l.county_fips
        GROUP BY x.band) t ON g.band = t.band
  LEFT JOIN (SELECT l.cluster, x.band, count(*) AS n FROM income_band x JOIN labels l
               ON x.county_fips = l.county_fips GROUP BY l.cluster, x.band) c
    ON g.cluster = c.cluster AND g.band = c.band""", ("income_band", "labels"))


def _income(spark, d):
    b = views.boundaries(spark, d).select("county_fips")
    return b.join(views.demographics(spark, d).select("county_fips", "median_income"), "county_fips", "left")


@register("h14_normalized_crosstab", with_("parity") + "SELECT * FROM parity", ("share",))
def h14(spark, d):
    return privacy.parity_shares(_income(spark, d), views.assignments(spark, d), "median_income")


@register("v03_demographic_parity", with_("parity") + """
SELECT 'median_income' AS attribute, avg(sd) AS bias_score, avg(sd) > 0.3 AS flagged
FROM (SELECT cluster, stddev_samp(share) AS sd FROM parity GROUP BY cluster) AS s""", ("bias_score",))
def v03(spark, d):
    return privacy.demographic_parity(_income(spark, d), views.assignments(spark, d), "median_income")


@register("v04_cluster_balance", with_("labels") + """
SELECT stddev_samp(n) / avg(n) AS size_coefficient_variation, coalesce(stddev_samp(n) / avg(n) > 1.0, false) AS flagged
FROM (SELECT cluster, count(*) AS n FROM labels GROUP BY cluster) AS s""", ("size_coefficient_variation",))
def v04(spark, d):
    return privacy.cluster_balance(views.assignments(spark, d))


_V05_FEATS = CC.CLUSTER_FEATURES + ["median_income"]


@register("v05_protected_attribute_correlation", with_("cluster_raw", "demographics") + """,
x AS (SELECT c.*, d.median_income FROM cluster_raw c LEFT JOIN demographics d ON c.county_fips = d.county_fips),
l AS (SELECT county_fips, feature, value FROM x UNPIVOT INCLUDE NULLS (value FOR feature IN ("""
          + ", ".join(_V05_FEATS) + """))),
cen AS (SELECT l.county_fips, l.feature, l.value - m.mu AS c FROM l
        JOIN (SELECT feature, avg(value) AS mu FROM l GROUP BY feature) m ON l.feature = m.feature)
SELECT a.feature, abs(sum(a.c * b.c) / nullif(sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 0)) AS abs_corr
FROM cen a JOIN cen b ON a.county_fips = b.county_fips AND b.feature = 'median_income'
GROUP BY a.feature HAVING abs(sum(a.c * b.c) / nullif(sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 0)) > 0.7""",
          ("abs_corr",))
def v05(spark, d):
    """Features with |corr| > 0.7 to median income (itself included)."""
    from tessera.operators import prep
    wide = CC.county_features(spark, d).join(views.demographics(spark, d).select("county_fips", "median_income"),
                                             "county_fips", "left")
    pairs = prep.correlation_pairs(wide, _V05_FEATS)
    return (pairs.where((F.col("feature_j") == "median_income") & (F.abs("corr") > 0.7))
            .select(F.col("feature_i").alias("feature"), F.abs("corr").alias("abs_corr")))


@register("v06_geographic_privacy", with_("trips_enriched") + """
SELECT t.trip_id, t.start_station_id, t.end_station_id,
       CASE WHEN s.n < 1000 THEN 'OTHER' ELSE t.county_fips END AS county_fips
FROM trips_enriched t LEFT JOIN (SELECT county_fips, count(*) AS n FROM trips_enriched GROUP BY county_fips) s
  ON t.county_fips = s.county_fips""")
def v06(spark, d):
    t = context(spark, d).enriched_trips().select("trip_id", "start_station_id", "end_station_id", "county_fips")
    return privacy.geographic_privacy(t, 1000)


@register("h16_min_group_size", with_("spending") + """
SELECT min(n) AS k_anonymity_level, count(*) AS groups, min(n) < 5 AS needs_aggregation
FROM (SELECT county_fips, count(*) AS n FROM spending GROUP BY county_fips) AS g""")
def h16(spark, d):
    return privacy.k_anonymity(context(spark, d).spending())


@register("h10_stations_per_county", with_("assigned") + """
SELECT count(*) AS counties, avg(n) AS mean_stations, min(n) AS min_stations, max(n) AS max_stations,
       sum(trips) AS total_station_trips, avg(trips) AS mean_county_trips
FROM (SELECT county_fips, count(*) AS n, sum(trip_count) AS trips FROM assigned WHERE county_fips IS NOT NULL
      GROUP BY county_fips) AS g""", ("mean_stations", "mean_county_trips"))
def h10(spark, d):
    a = context(spark, d).assigned().where(F.col("county_fips").isNotNull())
    g = a.groupBy("county_fips").agg(F.count(F.lit(1)).alias("n"), F.sum("trip_count").alias("trips"))
    return g.agg(F.count(F.lit(1)).alias("counties"), F.avg("n").alias("mean_stations"),
                 F.min("n").alias("min_stations"), F.max("n").alias("max_stations"),
                 F.sum("trips").alias("total_station_trips"), F.avg("trips").alias("mean_county_trips"))


@register("h11_county_mobility_summary", with_("county_mobility") + """
SELECT count(*) AS counties, sum(total_trips) AS total_trips, avg(total_trips) AS mean_trips,
       avg(avg_trip_duration_minutes) AS mean_duration, avg(member_ratio) AS mean_member_ratio
FROM county_mobility""", ("mean_trips", "mean_duration", "mean_member_ratio"))
def h11(spark, d):
    m = context(spark, d).county_mobility()
    return m.agg(F.count(F.lit(1)).alias("counties"), F.sum("total_trips").alias("total_trips"),
                 F.avg("total_trips").alias("mean_trips"), F.avg("avg_trip_duration_minutes").alias("mean_duration"),
                 F.avg("member_ratio").alias("mean_member_ratio"))


cte("flow_base", """
SELECT m.county_fips, m.total_trips, s.total_spending FROM county_mobility m JOIN spend_props s
  ON m.county_fips = s.county_fips""", ("county_mobility", "spend_props"))


@register("h13_d13_mobility_spending_flow", with_("flow_base") + f"""
SELECT mobility_band, spending_band, count(*) AS counties FROM (
  SELECT {_band_sql('total_trips', 'flow_base')} AS mobility_band,
         {_band_sql('total_spending', 'flow_base')} AS spending_band FROM flow_base) AS x
GROUP BY mobility_band, spending_band""")
def h13(spark, d):
    """F06 equal-width bands of trips and spending (J01 join), then the
    cross table of band pairs with a count > 0."""
    ctx = context(spark, d)
    base = ctx.county_mobility().select("county_fips", "total_trips").join(
        ctx.spending_features().select("county_fips", "total_spending"), "county_fips")
    b = equal_width_cut(base, "total_trips", out="mobility_band")
    b = equal_width_cut(b, "total_spending", out="spending_band")
    return b.groupBy("mobility_band", "spending_band").agg(F.count(F.lit(1)).alias("counties"))


@register("f06_equal_width_cut", with_("flow_base") + f"""
SELECT county_fips, {_band_sql('total_trips', 'flow_base')} AS mobility_band FROM flow_base""")
def f06(spark, d):
    ctx = context(spark, d)
    base = ctx.county_mobility().select("county_fips", "total_trips")
    return equal_width_cut(base, "total_trips", out="mobility_band").select("county_fips", "mobility_band")


cte("city_of_county", """
SELECT b.county_fips, r.r_name AS city FROM bnd b JOIN region r ON b.region_key = r.r_regionkey""", ("bnd",))


@register("h15_city_comparison", with_("city_of_county", "county_mobility", "spend_props", "labels") + """
SELECT c.city, count(*) AS counties, sum(m.total_trips) AS total_trips, sum(s.total_spending) AS total_spending,
       avg(m.member_ratio) AS mean_member_ratio, count(DISTINCT l.cluster) FILTER (WHERE l.cluster <> -1) AS segments
FROM city_of_county c JOIN county_mobility m ON c.county_fips = m.county_fips
JOIN spend_props s ON c.county_fips = s.county_fips JOIN labels l ON c.county_fips = l.county_fips
GROUP BY c.city""", (("total_spending", 4), "mean_member_ratio"))
def h15(spark, d):
    """Per city (region of the county): counties, trips, spending, mean
    member share and number of segments present."""
    from tessera.sources.tables import table
    ctx = context(spark, d)
    region = table(spark, d, "region")
    city = views.boundaries(spark, d).join(region, F.col("region_key") == F.col("r_regionkey")).select(
        "county_fips", F.col("r_name").alias("city"))
    j = (city.join(ctx.county_mobility().select("county_fips", "total_trips", "member_ratio"), "county_fips")
         .join(ctx.spending_features().select("county_fips", "total_spending"), "county_fips")
         .join(views.assignments(spark, d), "county_fips"))
    return j.groupBy("city").agg(
        F.count(F.lit(1)).alias("counties"), F.sum("total_trips").alias("total_trips"),
        F.sum("total_spending").alias("total_spending"), F.avg("member_ratio").alias("mean_member_ratio"),
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("segments"))


@register("a15_city_trip_adapter", with_("trips_enriched", "city_of_county") + """
SELECT c.city, count(*) AS trips, count(DISTINCT t.start_station_id) AS stations
FROM trips_enriched t JOIN city_of_county c ON t.county_fips = c.county_fips GROUP BY c.city""")
def a15(spark, d):
    """Each city's trips in the trips schema with a ``city`` column (the
    city of the start county via the region dimension), per city."""
    from tessera.sources.tables import table
    ctx = context(spark, d)
    region = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("city"))
    city = views.boundaries(spark, d).join(region, F.col("region_key") == F.col("r_regionkey")).select(
        "county_fips", "city")
    t = ctx.enriched_trips().join(city, "county_fips")
    return t.groupBy("city").agg(F.count(F.lit(1)).alias("trips"),
                                 F.count_distinct("start_station_id").alias("stations"))


@register("d11_station_legend_counts", with_("assigned") + """
SELECT county_fips, county_name, count(*) AS stations FROM assigned WHERE county_fips IS NOT NULL
GROUP BY county_fips, county_name""")
def d11(spark, d):
    a = context(spark, d).assigned().where(F.col("county_fips").isNotNull())
    return a.groupBy("county_fips", "county_name").agg(F.count(F.lit(1)).alias("stations"))


@register("d12_seasonal_map_frames", with_("personas") + " UNION ALL ".join(
    f"SELECT persona_id, '{s}' AS season, {s} * market_value / max({s} * market_value) OVER () * 20 + 5 "
    f"AS marker_size FROM personas" for s in ("spring", "summer", "fall", "winter")), ("marker_size",))
def d12(spark, d):
    """Per season: marker size = value / max(value) · 20 + 5, with value =
    seasonal multiplier × market value (window max per season)."""
    p = CP.persona_table(spark, d)
    ex = p.select("persona_id", "market_value", F.explode("seasonal_trends").alias("season", "m"))
    v = F.col("m") * F.col("market_value")
    w = Window.partitionBy("season")
    return ex.select("persona_id", "season", (v / F.max(v).over(w) * 20 + 5).alias("marker_size"))


@register("d15_t01_county_mobility_panel", with_("county_mobility") + """
SELECT CAST(row_number() OVER (ORDER BY total_trips, county_fips) AS BIGINT) AS position,
       coalesce(county_name, county_fips) AS label, total_trips, avg_trip_duration_minutes, trips_per_sq_km,
       member_ratio FROM county_mobility""", ("avg_trip_duration_minutes", "trips_per_sq_km", "member_ratio"))
def d15(spark, d):
    """T01 ascending order by trips (position kept as a column), name or
    FIPS as the label."""
    m = context(spark, d).county_mobility()
    w = Window.orderBy("total_trips", "county_fips")
    return m.select(F.row_number().over(w).alias("position"),
                    F.coalesce("county_name", "county_fips").alias("label"), "total_trips",
                    "avg_trip_duration_minutes", "trips_per_sq_km", "member_ratio")


@register("t09_best_roi_largest_market", with_("opportunities") + f"""
SELECT first(opportunity_type ORDER BY {CP._ROI_HI} DESC, rule_order) AS best_roi_opportunity,
       max({CP._ROI_HI}) AS best_roi_high,
       first(opportunity_type ORDER BY estimated_market_size DESC, rule_order) AS largest_market_opportunity
FROM opportunities""", ("best_roi_high",))
def t09(spark, d):
    o = CP.opportunity_table(spark, d)
    _, hi, _ = text.roi_range(F.col("expected_roi"))
    o = o.withColumn("roi_high", hi)
    return o.agg(F.max_by("opportunity_type", F.struct("roi_high", -F.col("rule_order"))).alias("best_roi_opportunity"),
                 F.max("roi_high").alias("best_roi_high"),
                 F.max_by("opportunity_type", F.struct("estimated_market_size", -F.col("rule_order")))
                 .alias("largest_market_opportunity"))


@register("a01_load_saved_data", "SELECT * FROM nation")
def a01(spark, d):
    """Reader chosen by the file suffix (Parquet here)."""
    return io.load_saved_data(spark, f"{d}/nation.parquet")


@register("a04_trips_source_year_month", with_("trips") + """
SELECT trip_id, start_time, start_station_id, end_station_id, member_type FROM trips
WHERE year(start_time) = 1998 AND month(start_time) = 6""")
def a04(spark, d):
    """Trips of one year/month; a superset date predicate reaches the
    orders scan (PushedFilters), the exact one is applied after."""
    t = views.trips(spark, d, "1998-06-01", "1998-07-01")
    return t.where((F.year("start_time") == 1998) & (F.month("start_time") == 6)).select(
        "trip_id", "start_time", "start_station_id", "end_station_id", "member_type")


@register("a05_spending_for_counties", with_("spending") + f"""
SELECT county_fips, year, month, category, spending_amount FROM spending WHERE county_fips IN {_SET_SQL}""",
          (("spending_amount", 4),))
def a05(spark, d):
    return views.spending(spark, d, COUNTY_SET).drop("date")


@register("a06_boundaries_for_counties", with_("bnd") + f"""
SELECT county_fips, county_name, x0 AS min_lng, y0 AS min_lat FROM bnd WHERE county_fips IN {_SET_SQL}""",
          ("min_lng", "min_lat"))
def a06(spark, d):
    b = views.boundaries(spark, d).where(F.col("county_fips").isin(*COUNTY_SET))
    return b.select("county_fips", "county_name", F.col("ring")[0]["lng"].alias("min_lng"),
                    F.col("ring")[0]["lat"].alias("min_lat"))


@register("a07_population_for_counties", with_("population") + f"""
SELECT county_fips, year, population FROM population WHERE county_fips IN {_SET_SQL}""")
def a07(spark, d):
    return views.population(spark, d, COUNTY_SET).select(
        "county_fips", "year", "population")


@register("a08_demographics_for_counties", with_("demographics") + f"""
SELECT * FROM demographics WHERE county_fips IN {_SET_SQL}""",
          (("median_income", 4), "age_18_34_pct", "age_35_54_pct", "age_55_plus_pct", "bachelor_plus_pct",
           "high_school_pct"))
def a08(spark, d):
    return views.demographics(spark, d, COUNTY_SET).drop("population_density")


@register("a14_spatial_visualization_data", with_("assigned", "bnd") + """
SELECT 'station' AS layer, CAST(station_id AS VARCHAR) AS id, lat, lng, county_fips, CAST(trip_count AS BIGINT) AS size
FROM assigned
UNION ALL SELECT 'boundary', county_fips, centroid_lat, centroid_lng, county_fips, CAST(0 AS BIGINT) FROM bnd""", ("lat", "lng"))
def a14(spark, d):
    """Station markers and boundary centroids for a map as one table
    (layer, id, lat, lng, county, size; 0 for boundaries) instead of a single
    collected list."""
    ctx = context(spark, d)
    st = ctx.assigned().select(F.lit("station").alias("layer"), F.col("station_id").cast("string").alias("id"),
                               "lat", "lng", "county_fips", F.col("trip_count").cast("long").alias("size"))
    b = ctx.prepared().select(F.lit("boundary").alias("layer"), F.col("county_fips").alias("id"),
                              F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"), "county_fips",
                              F.lit(0).cast("long").alias("size"))
    return st.unionByName(b)
