"""Registered queries that give SURVEY §2 operators their own key where
the work is shared with another key (same operator functions, same
oracle CTEs): A02/A03/A09, B23, D10, D14, F13, F15, F18, H01, J02, J06,
J07, J09, R05, R06."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import privacy, spatial
from tessera.operators import predict as R
from tessera.oracle.views import with_
from tessera.plans import catalog_models as CM
from tessera.plans import catalog_personas as CP
from tessera.plans import catalog_rollups  # noqa: F401  (CTEs)
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import io, views

_H01_D = ("avg_trip_duration_minutes", "median_trip_duration_minutes", "std_trip_duration_minutes",
          "avg_trip_distance_km", "median_trip_distance_km", "std_trip_distance_km", "avg_trip_speed_kmh",
          "median_trip_speed_kmh", "member_ratio", "inter_county_ratio")


@register("h01_perform_county_aggregation", with_("county_agg") + "SELECT * FROM county_agg", _H01_D)
def h01(spark, d):
    """County trip statistics from the enriched trips (no metadata join)."""
    return spatial.county_aggregation(context(spark, d).enriched_trips())


@register("j02_left_join_county_metadata", with_("county_mobility") + """
SELECT county_fips, total_trips, county_name, area_sq_km, centroid_lat, centroid_lng, trips_per_sq_km
FROM county_mobility""", (("area_sq_km", 4), "centroid_lat", "centroid_lng", "trips_per_sq_km"))
def j02(spark, d):
    ctx = context(spark, d)
    agg = ctx.county_mobility().select("county_fips", "total_trips")
    return spatial.add_county_metadata(agg, ctx.prepared()).select(
        "county_fips", "total_trips", "county_name", "area_sq_km", "centroid_lat", "centroid_lng", "trips_per_sq_km")


@register("j06_theta_join_point_in_polygon", with_("inside") + "SELECT station_id, county_fips FROM inside")
def j06(spark, d):
    ctx = context(spark, d)
    return spatial.points_in_polygons(ctx.stations(), ctx.prepared())


@register("j07_nearest_neighbour_join", with_("nearest") + "SELECT station_id, county_fips FROM nearest")
def j07(spark, d):
    ctx = context(spark, d)
    inside = spatial.points_in_polygons(ctx.stations(), ctx.prepared())
    return spatial.nearest_centroid(ctx.stations().join(inside, "station_id", "left_anti"), ctx.prepared())


@register("j09_join_mobility_lagged_spending", with_("prediction_data") + """
SELECT county_fips, date, total_trips, spending_lag_1 FROM prediction_data""", (("spending_lag_1", 4),))
def j09(spark, d):
    return CM._prediction_data(spark, d).select("county_fips", "date", "total_trips", "spending_lag_1")


@register("b23_persona_filter", with_("personas") + """
SELECT persona_id, persona_name FROM personas WHERE cluster_id % 2 = 0""")
def b23(spark, d):
    """Keep the selected persona ids (a semi join against the selection)."""
    p = CP.persona_table(spark, d)
    sel = p.where(F.pmod(F.col("cluster_id"), F.lit(2)) == 0).select("persona_id")
    return p.join(sel, "persona_id", "left_semi").select("persona_id", "persona_name")


@register("d10_roi_ranges", with_("opportunities") + f"""
SELECT opportunity_type, {CP._ROI_LO} AS roi_low, {CP._ROI_HI} AS roi_high,
       ({CP._ROI_LO} + {CP._ROI_HI}) / 2.0 AS roi_mid FROM opportunities""", ("roi_low", "roi_high", "roi_mid"))
def d10(spark, d):
    o = CP.opportunity_table(spark, d)
    lo, hi, mid = text.roi_range(F.col("expected_roi"))
    return o.select("opportunity_type", lo.alias("roi_low"), hi.alias("roi_high"), mid.alias("roi_mid"))


@register("f13_clip_seasonal_multipliers", with_("personas") + """
SELECT persona_id, spring, summer, fall, winter FROM personas""", ("spring", "summer", "fall", "winter"))
def f13(spark, d):
    """Seasonal multipliers clipped to [0.3, 1.8]."""
    st = F.col("seasonal_trends")
    return CP.persona_table(spark, d).select("persona_id", *[st[s].alias(s) for s in ("spring", "summer", "fall",
                                                                                     "winter")])


@register("f18_title_case", with_("spending") + """
SELECT DISTINCT category, upper(substr(category, 1, 1)) || substr(category, 2) AS label FROM spending""")
def f18(spark, d):
    s = context(spark, d).spending().select("category").distinct()
    return s.select("category", text.title_case(F.col("category")).alias("label"))


@register("d14_algorithm_metrics_panel")
def d14(spark, d):
    """Silhouette, clusters and outliers per algorithm (K13 projection)."""
    return CM.k13(spark, d, with_stability=False).select("algorithm", "silhouette", "n_clusters", "n_outliers")


@register("f15_name_pattern_flags", catalog_rollups.identifier_sql("spending", "population"))
def f15(spark, d):
    """Substring flags on column names, and what the columns hold (the V01 scan over the area tables)."""
    return privacy.identifier_scan({"spending": context(spark, d).spending().drop("date"),
                                    "population": views.population(spark, d).select("county_fips", "year", "population")})


@register("r05_grid_search_and_refit")
def r05(spark, d):
    """Mean fold MSE of every random-forest grid point; best marked."""
    return R.train_spending_predictor(CM._prediction_data(spark, d), "random_forest")["grid"]


@register("r06_regression_metrics")
def r06(spark, d):
    """R² and RMSE of the refit model's predictions by formula."""
    res = R.train_spending_predictor(CM._prediction_data(spark, d), "random_forest")
    return R.regression_metrics(res["predictions"])


@register("a02_a03_a09_save_processed_data", with_("spending") + """
SELECT count(*) AS rows_read, count(*) AS record_count, count(DISTINCT county_fips) AS unique_counties FROM spending""")
def a02(spark, d):
    """Spending written as Parquet with its JSON metadata sidecar (record
    and distinct-county counts from the same write), read back."""
    import json
    import uuid
    base = io.scratch_path(spark, "processed-" + uuid.uuid4().hex[:8])
    meta = io.save_processed_data(context(spark, d).spending(), base + "/spending.parquet", {"source": "spending"},
                                  distinct_col="county_fips")
    side = json.loads(spark.read.text(base + "/spending.parquet.metadata.json").first()[0])
    back = io.load_saved_data(spark, base + "/spending.parquet")
    return back.agg(F.count(F.lit(1)).alias("rows_read")).select(
        "rows_read", F.lit(side["record_count"]).alias("record_count"),
        F.lit(meta["unique_county_fips"]).alias("unique_counties"))
