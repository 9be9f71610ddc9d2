"""Registered queries: spending aggregates, time series and features
(H03-H06, H09, W01-W04, W06-W08, E01-E08, J01, J04, J05, J09, J10)."""

from __future__ import annotations

from tessera.operators import features, spending
from tessera.oracle.views import cte, with_
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import views

CATS = spending.CATEGORIES
D = "CAST({} AS DOUBLE)"


def _sum_chain(cols):
    acc = cols[0]
    for c in cols[1:]:
        acc = f"({acc} + {c})"
    return acc


# ----------------------------------------------------------- DuckDB twins
cte("spend_pivot", "SELECT county_fips, " + ", ".join(
    f"coalesce(sum(spending_amount) FILTER (WHERE category = '{c}'), 0.0) AS spending_{c}" for c in CATS)
    + " FROM spending GROUP BY county_fips", ("spending",))

_TOTAL = _sum_chain([f"spending_{c}" for c in CATS])
_ENT = _sum_chain([f"((spending_pct_{c} + 1e-10) * ln(spending_pct_{c} + 1e-10))" for c in CATS])
cte("spend_props", f"SELECT *, -({_ENT}) AS spending_diversity FROM (SELECT *, " + ", ".join(
    f"coalesce(spending_{c} / nullif(total_spending, 0), 0.0) AS spending_pct_{c}" for c in CATS)
    + " FROM (SELECT *, " + _TOTAL + " AS total_spending FROM spend_pivot) AS t) AS u", ("spend_pivot",))

_MAX = "greatest(" + ", ".join(f"spending_pct_{c}" for c in CATS) + ")"
_DOM = "CASE " + " ".join(f"WHEN spending_pct_{c} = {_MAX} THEN 'spending_pct_{c}'" for c in CATS) + " END"
_ESS = _sum_chain([f"spending_{c}" for c in spending.ESSENTIAL])
_DIS = _sum_chain([f"spending_{c}" for c in spending.DISCRETIONARY])
cte("spend_intensity", f"""
SELECT *, CASE WHEN total_spending <= q1 THEN 'Low' WHEN total_spending <= q3 THEN 'Medium'
               WHEN total_spending IS NOT NULL THEN 'High' END AS spending_intensity_category,
       {_DOM} AS dominant_spending_category, {_MAX} AS dominant_spending_share,
       {_ESS} AS essential_spending, {_DIS} AS discretionary_spending,
       coalesce(({_DIS}) / nullif(({_ESS}) + ({_DIS}), 0), 0.0) AS discretionary_ratio
FROM spend_props, (SELECT quantile_cont(total_spending, 0.25) AS q1, quantile_cont(total_spending, 0.75) AS q3
                   FROM spend_props) AS q""", ("spend_props",))

cte("spend_eligible", """
SELECT * FROM spending WHERE county_fips IN
  (SELECT county_fips FROM spending GROUP BY county_fips HAVING count(*) >= 2)""", ("spending",))

cte("spend_volatility", "SELECT county_fips, " + ", ".join(
    f"first(cv) FILTER (WHERE category = '{c}') AS spending_volatility_{c}" for c in CATS) + """
FROM (SELECT county_fips, category,
             CASE WHEN count(spending_amount) > 1 AND avg(spending_amount) > 0
                  THEN stddev_samp(spending_amount) / nullif(avg(spending_amount), 0) END AS cv
      FROM spend_eligible GROUP BY county_fips, category) AS g GROUP BY county_fips""", ("spend_eligible",))

cte("spend_trend", """
SELECT county_fips, regr_slope(spending_amount, x) AS spending_trend FROM (
  SELECT county_fips, spending_amount,
         CAST(row_number() OVER (PARTITION BY county_fips ORDER BY year, month) - 1 AS DOUBLE) AS x
  FROM (SELECT county_fips, year, month, sum(spending_amount) AS spending_amount FROM spend_eligible
        GROUP BY county_fips, year, month) AS p) AS r
GROUP BY county_fips HAVING count(*) > 2""", ("spend_eligible",))

cte("population", """
SELECT county_fips, year, population, population / nullif(b.area_sq_km, 0) AS population_density_per_sq_km
FROM (SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county_fips, y.year,
             CAST(count(*) * y.mult AS BIGINT) AS population
      FROM customer, (VALUES (2022, 1000), (2023, 1010)) AS y(year, mult)
      GROUP BY c_nationkey, y.year, y.mult) AS p
LEFT JOIN (SELECT county_fips AS f, area_sq_km FROM bnd) AS b ON p.county_fips = b.f""", ("bnd",))

cte("pop_latest", """
SELECT county_fips, population FROM population WHERE year = (SELECT max(year) FROM population)""",
    ("population",))

cte("spend_features", "SELECT i.*, " + ", ".join(f"vt.spending_volatility_{c}" for c in CATS)
    + ", vt.spending_trend, p.population, " + ", ".join(
        f"i.spending_{c} / nullif(CAST(p.population AS DOUBLE), 0) AS spending_per_capita_{c}" for c in CATS)
    + """, i.total_spending / nullif(CAST(p.population AS DOUBLE), 0) AS total_spending_per_capita
FROM spend_intensity i
LEFT JOIN (SELECT coalesce(v.county_fips, t.county_fips) AS county_fips, """
    + ", ".join(f"v.spending_volatility_{c}" for c in CATS) + """, t.spending_trend
           FROM spend_volatility v FULL OUTER JOIN spend_trend t ON v.county_fips = t.county_fips) AS vt
  ON i.county_fips = vt.county_fips
LEFT JOIN pop_latest p ON i.county_fips = p.county_fips""", ("spend_intensity", "spend_volatility", "spend_trend",
                                                            "pop_latest"))

_PEAK = "hour(start_time) IN (7, 8, 17, 18)"
_NIGHT = "hour(start_time) IN (22, 23, 0, 1, 2, 3, 4, 5)"
cte("temporal_patterns", f"""
SELECT county_fips, avg(CAST({_PEAK} AS DOUBLE)) AS peak_hour_ratio,
       avg(CAST(isodow(start_time) IN (6, 7) AS DOUBLE)) AS weekend_ratio,
       avg(CAST({_NIGHT} AS DOUBLE)) AS night_trips_ratio,
       avg(CAST(month(start_time) IN (6, 7, 8) AS DOUBLE)) AS summer_trips_ratio,
       avg(CAST(month(start_time) IN (12, 1, 2) AS DOUBLE)) AS winter_trips_ratio,
       abs(avg(CAST(month(start_time) IN (6, 7, 8) AS DOUBLE))
           - avg(CAST(month(start_time) IN (12, 1, 2) AS DOUBLE))) AS seasonal_variation
FROM trips_enriched WHERE county_fips IS NOT NULL GROUP BY county_fips""", ("trips_enriched",))

cte("mobility_features", """
SELECT *, CASE WHEN trips_per_capita IS NOT NULL THEN least(trips_per_capita / 10.0, 1.0) END
          AS mobility_penetration_rate
FROM (SELECT m.*, tp.peak_hour_ratio, tp.weekend_ratio, tp.night_trips_ratio, tp.summer_trips_ratio,
             tp.winter_trips_ratio, tp.seasonal_variation,
             CASE WHEN m.avg_trip_duration_minutes < 10 THEN 1 ELSE 0 END AS short_trip_preference,
             CASE WHEN m.avg_trip_duration_minutes > 30 THEN 1 ELSE 0 END AS long_trip_preference,
             m.std_trip_duration_minutes AS trip_duration_variability,
             CASE WHEN m.avg_trip_distance_km < 2 THEN 1 ELSE 0 END AS short_distance_preference,
             CASE WHEN m.avg_trip_distance_km > 8 THEN 1 ELSE 0 END AS long_distance_preference,
             CASE WHEN m.inter_county_ratio > 0.1 THEN 1 ELSE 0 END AS high_inter_county_mobility,
             sqrt(m.total_trips / 100.0) AS estimated_stations,
             sqrt(m.total_trips / 100.0) / nullif(m.area_sq_km, 0) AS station_density_per_sq_km,
             CASE WHEN m.total_trips <= q.p33 THEN 'Low' WHEN m.total_trips <= q.p67 THEN 'Medium'
                  WHEN m.total_trips IS NOT NULL THEN 'High' END AS trip_volume_category,
             m.total_trips / nullif(sqrt(m.total_trips / 100.0), 0) AS trips_per_station,
             p.population,
             CAST(m.total_trips AS DOUBLE) / nullif(CAST(p.population AS DOUBLE), 0) * 1000 AS trips_per_capita,
             CAST(m.member_trips AS DOUBLE) / nullif(CAST(p.population AS DOUBLE), 0) * 1000
               AS member_trips_per_capita,
             CAST(m.casual_trips AS DOUBLE) / nullif(CAST(p.population AS DOUBLE), 0) * 1000
               AS casual_trips_per_capita
      FROM county_mobility m
      LEFT JOIN temporal_patterns tp ON m.county_fips = tp.county_fips
      LEFT JOIN pop_latest p ON m.county_fips = p.county_fips,
      (SELECT quantile_cont(CAST(total_trips AS DOUBLE), 0.33) AS p33,
              quantile_cont(CAST(total_trips AS DOUBLE), 0.67) AS p67 FROM county_mobility) AS q) AS x""",
    ("county_mobility", "temporal_patterns", "pop_latest"))


# --------------------------------------------------------------- queries
def _mob_features(spark, d):
    return context(spark, d).mobility_features()


def _spend_features(spark, d):
    return spending.create_spending_features(context(spark, d).spending(), views.population(spark, d))


_BIG = 4  # money sums are exact to 4 decimals; rounding to 2 would hit .xx5 ties


@register("h03_join_mobility_spending", with_("county_mobility", "spending") + "SELECT m.county_fips, m.total_trips, "
          "m.avg_trip_duration_minutes, " + ", ".join(
              f"s.spending_{c}" for c in CATS) + " FROM county_mobility m JOIN (SELECT county_fips, " + ", ".join(
              f"sum(spending_amount) FILTER (WHERE category = '{c}') AS spending_{c}" for c in CATS)
          + " FROM spending GROUP BY county_fips) s ON m.county_fips = s.county_fips",
          ("avg_trip_duration_minutes",) + tuple((f"spending_{c}", _BIG) for c in CATS))
def h03(spark, d):
    mob = context(spark, d).county_mobility().select(
        "county_fips", "total_trips", "avg_trip_duration_minutes")
    return spending.join_mobility_spending(mob, context(spark, d).spending())


@register("h04_aggregate_spending_data", with_("spending") + """
SELECT county_fips, category, sum(spending_amount) AS spending_amount_sum, avg(spending_amount) AS spending_amount_mean,
       stddev_samp(spending_amount) AS spending_amount_std, count(spending_amount) AS spending_amount_count
FROM spending GROUP BY county_fips, category""",
          (("spending_amount_sum", _BIG), ("spending_amount_mean", _BIG), ("spending_amount_std", _BIG)))
def h04(spark, d):
    return spending.aggregate_spending(context(spark, d).spending(), ["county_fips", "category"])


@register("h05_pivot_spending_data", with_("spend_pivot") + "SELECT * FROM spend_pivot",
          tuple((f"spending_{c}", _BIG) for c in CATS))
def h05(spark, d):
    return spending.pivot_spending(context(spark, d).spending())


@register("h09_county_spending_by_period", with_("spending") + """
SELECT county_fips, year, month, sum(spending_amount) AS spending_amount FROM spending
GROUP BY county_fips, year, month""", (("spending_amount", _BIG),))
def h09(spark, d):
    return spending.spending_by_period(context(spark, d).spending())


cte("spend_lags", """
SELECT county_fips, year, month, spending_amount, make_timestamp(year, month, 1, 0, 0, 0) AS date,
       CAST(quarter(make_date(year, month, 1)) AS BIGINT) AS quarter,
       CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Spring'
            WHEN month IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
       lag(spending_amount, 1) OVER w AS spending_lag_1,
       lag(spending_amount, 3) OVER w AS spending_lag_3,
       CASE WHEN count(spending_amount) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
            THEN avg(spending_amount) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS spending_ma_3
FROM (SELECT county_fips, year, month, sum(spending_amount) AS spending_amount FROM spending
      GROUP BY county_fips, year, month) AS p
WINDOW w AS (PARTITION BY county_fips ORDER BY make_date(year, month, 1))""", ("spending",))


def _lags(spark, d):
    return spending.add_lag_features(spending.spending_by_period(context(spark, d).spending()))


@register("w01_lag_features", with_("spend_lags") + """
SELECT county_fips, year, month, spending_lag_1, spending_lag_3 FROM spend_lags""",
          (("spending_lag_1", _BIG), ("spending_lag_3", _BIG)))
def w01(spark, d):
    return _lags(spark, d).select("county_fips", "year", "month", "spending_lag_1", "spending_lag_3")


@register("w02_rolling_mean_3", with_("spend_lags") + "SELECT county_fips, year, month, spending_ma_3 FROM spend_lags",
          (("spending_ma_3", _BIG),))
def w02(spark, d):
    return _lags(spark, d).select("county_fips", "year", "month", "spending_ma_3")


@register("w07_calendar_keys", with_("spend_lags") + """
SELECT county_fips, year, month, date, quarter, season FROM spend_lags""")
def w07(spark, d):
    return _lags(spark, d).select("county_fips", "year", "month", "date", "quarter", "season")


@register("w03_spending_trend", with_("spend_trend") + "SELECT * FROM spend_trend", (("spending_trend", 2),))
def w03(spark, d):
    return spending.spending_trend(context(spark, d).spending())


@register("w04_spending_volatility", with_("spend_volatility") + "SELECT * FROM spend_volatility",
          tuple(f"spending_volatility_{c}" for c in CATS), digits=8)
def w04(spark, d):
    return spending.spending_volatility(context(spark, d).spending())


@register("w06_within_county_share", with_("spend_props") + "SELECT county_fips, " + ", ".join(
    f"spending_pct_{c}" for c in CATS) + " FROM spend_props", tuple(f"spending_pct_{c}" for c in CATS), digits=8)
def w06(spark, d):
    p = spending.add_spending_proportions(spending.pivot_spending(context(spark, d).spending()))
    return p.select("county_fips", *[f"spending_pct_{c}" for c in CATS])


_E05_D = tuple((f"spending_{c}", _BIG) for c in CATS) + (("total_spending", _BIG),) + tuple(
    (f"spending_pct_{c}", 8) for c in CATS) + (("spending_diversity", 8),)


@register("e05_spending_proportions", with_("spend_props") + "SELECT * FROM spend_props", _E05_D)
def e05(spark, d):
    return spending.add_spending_proportions(spending.pivot_spending(context(spark, d).spending()))


_E06_D = _E05_D + (("dominant_spending_share", 8), ("essential_spending", _BIG),
                   ("discretionary_spending", _BIG), ("discretionary_ratio", 8))


@register("e06_spending_intensity", with_("spend_intensity") + "SELECT * EXCLUDE (q1, q3) FROM spend_intensity",
          _E06_D)
def e06(spark, d):
    p = spending.add_spending_proportions(spending.pivot_spending(context(spark, d).spending()))
    return spending.add_spending_intensity(p)


@register("f07_entropy_diversity", with_("spend_props") + "SELECT county_fips, spending_diversity FROM spend_props",
          (("spending_diversity", 8),))
def f07(spark, d):
    p = spending.add_spending_proportions(spending.pivot_spending(context(spark, d).spending()))
    return p.select("county_fips", "spending_diversity")


@register("f08_dominant_category", with_("spend_intensity") + """
SELECT county_fips, dominant_spending_category, dominant_spending_share FROM spend_intensity""",
          (("dominant_spending_share", 8),))
def f08(spark, d):
    p = spending.add_spending_proportions(spending.pivot_spending(context(spark, d).spending()))
    return spending.add_spending_intensity(p).select("county_fips", "dominant_spending_category",
                                                     "dominant_spending_share")


@register("f09_essential_discretionary", with_("spend_intensity") + """
SELECT county_fips, essential_spending, discretionary_spending, discretionary_ratio FROM spend_intensity""",
          (("essential_spending", _BIG), ("discretionary_spending", _BIG), ("discretionary_ratio", 8)))
def f09(spark, d):
    p = spending.add_spending_proportions(spending.pivot_spending(context(spark, d).spending()))
    return spending.add_spending_intensity(p).select("county_fips", "essential_spending",
                                                     "discretionary_spending", "discretionary_ratio")


@register("f05_quantile_cut_25_75", with_("spend_intensity") + """
SELECT county_fips, spending_intensity_category FROM spend_intensity""")
def f05(spark, d):
    p = spending.add_spending_proportions(spending.pivot_spending(context(spark, d).spending()))
    return spending.add_spending_intensity(p).select("county_fips", "spending_intensity_category")


_E08_D = _E06_D + tuple((f"spending_volatility_{c}", 8) for c in CATS) + (("spending_trend", 2),) + tuple(
    (f"spending_per_capita_{c}", 4) for c in CATS) + (("total_spending_per_capita", 4),)


@register("w08_spending_temporal_features", with_("spend_intensity", "spend_volatility", "spend_trend") +
          "SELECT i.county_fips, " + ", ".join(f"v.spending_volatility_{c}" for c in CATS) + """, t.spending_trend
FROM spend_intensity i LEFT JOIN spend_volatility v ON i.county_fips = v.county_fips
LEFT JOIN spend_trend t ON i.county_fips = t.county_fips""",
          tuple((f"spending_volatility_{c}", 8) for c in CATS) + (("spending_trend", 2),))
def w08(spark, d):
    s = context(spark, d).spending()
    base = spending.pivot_spending(s).select("county_fips")
    return spending.spending_temporal_features(base, s)


@register("e07_per_capita_spending", with_("spend_features") + "SELECT county_fips, population, " + ", ".join(
    f"spending_per_capita_{c}" for c in CATS) + ", total_spending_per_capita FROM spend_features",
          tuple((f"spending_per_capita_{c}", 4) for c in CATS) + (("total_spending_per_capita", 4),))
def e07(spark, d):
    f = _spend_features(spark, d)
    return f.select("county_fips", "population", *[f"spending_per_capita_{c}" for c in CATS],
                    "total_spending_per_capita")


@register("e08_create_spending_features", with_("spend_features") + "SELECT * EXCLUDE (q1, q3) FROM spend_features",
          _E08_D)
def e08(spark, d):
    return _spend_features(spark, d)


@register("j04_latest_year_population", with_("pop_latest") + "SELECT * FROM pop_latest")
def j04(spark, d):
    return spending.latest_population(views.population(spark, d))


@register("j05_semi_join_county_set", with_("spending", "station_map") + """
SELECT county_fips, year, month, category, spending_amount FROM spending
WHERE county_fips IN (SELECT county_fips FROM station_map)""", (("spending_amount", _BIG),))
def j05(spark, d):
    """Spending rows of counties that have at least one station."""
    prepared = context(spark, d).prepared()
    m = context(spark, d).station_map().select("county_fips")
    s = context(spark, d).spending().drop("date")
    return s.join(m, "county_fips", "left_semi")


@register("h06_temporal_patterns", with_("temporal_patterns") + "SELECT * FROM temporal_patterns",
          ("peak_hour_ratio", "weekend_ratio", "night_trips_ratio", "summer_trips_ratio", "winter_trips_ratio",
           "seasonal_variation"), digits=8)
def h06(spark, d):
    return context(spark, d).temporal_patterns()


_MOB_D = ("avg_trip_duration_minutes", "median_trip_duration_minutes", "std_trip_duration_minutes",
          "avg_trip_distance_km", "median_trip_distance_km", "std_trip_distance_km", "avg_trip_speed_kmh",
          "median_trip_speed_kmh", "member_ratio", "inter_county_ratio", ("area_sq_km", 4), "centroid_lat",
          "centroid_lng", "trips_per_sq_km", "peak_hour_ratio", "weekend_ratio", "night_trips_ratio",
          "summer_trips_ratio", "winter_trips_ratio", "seasonal_variation", "trip_duration_variability",
          "estimated_stations", "station_density_per_sq_km", "trips_per_station", "trips_per_capita",
          "member_trips_per_capita", "casual_trips_per_capita", "mobility_penetration_rate")


@register("e01_usage_patterns", with_("mobility_features") + """
SELECT county_fips, member_ratio, short_trip_preference, long_trip_preference, trip_duration_variability,
       short_distance_preference, long_distance_preference, high_inter_county_mobility FROM mobility_features""",
          ("member_ratio", "trip_duration_variability"))
def e01(spark, d):
    mob = context(spark, d).county_mobility()
    return features.add_usage_patterns(mob).select(
        "county_fips", "member_ratio", "short_trip_preference", "long_trip_preference", "trip_duration_variability",
        "short_distance_preference", "long_distance_preference", "high_inter_county_mobility")


@register("e02_volume_intensity", with_("mobility_features") + """
SELECT county_fips, estimated_stations, station_density_per_sq_km, trip_volume_category, trips_per_station
FROM mobility_features""", ("estimated_stations", "station_density_per_sq_km", "trips_per_station"))
def e02(spark, d):
    mob = context(spark, d).county_mobility()
    return features.add_volume_intensity(mob).select(
        "county_fips", "estimated_stations", "station_density_per_sq_km", "trip_volume_category",
        "trips_per_station")


@register("f04_quantile_cut_33_67", with_("mobility_features") + """
SELECT county_fips, total_trips, trip_volume_category FROM mobility_features""")
def f04(spark, d):
    mob = context(spark, d).county_mobility()
    return features.add_volume_intensity(mob).select("county_fips", "total_trips", "trip_volume_category")


@register("e03_per_capita_mobility", with_("mobility_features") + """
SELECT county_fips, population, trips_per_capita, member_trips_per_capita, casual_trips_per_capita,
       mobility_penetration_rate FROM mobility_features""",
          ("trips_per_capita", "member_trips_per_capita", "casual_trips_per_capita", "mobility_penetration_rate"))
def e03(spark, d):
    mob = context(spark, d).county_mobility()
    return features.add_per_capita_mobility(mob, views.population(spark, d)).select(
        "county_fips", "population", "trips_per_capita", "member_trips_per_capita", "casual_trips_per_capita",
        "mobility_penetration_rate")


@register("e04_create_mobility_features", with_("mobility_features") + "SELECT * FROM mobility_features", _MOB_D)
def e04(spark, d):
    return _mob_features(spark, d)


@register("j10_left_join_temporal_features", with_("county_mobility", "temporal_patterns") + """
SELECT m.county_fips, m.total_trips, tp.peak_hour_ratio, tp.weekend_ratio, tp.night_trips_ratio
FROM county_mobility m LEFT JOIN temporal_patterns tp ON m.county_fips = tp.county_fips""",
          ("peak_hour_ratio", "weekend_ratio", "night_trips_ratio"), digits=8)
def j10(spark, d):
    mob = context(spark, d).county_mobility().select("county_fips", "total_trips")
    tp = context(spark, d).temporal_patterns().select(
        "county_fips", "peak_hour_ratio", "weekend_ratio", "night_trips_ratio")
    return mob.join(tp, "county_fips", "left")


@register("j01_inner_join_mobility_spending", with_("county_mobility", "spend_pivot") + """
SELECT m.county_fips, m.total_trips, m.member_ratio, s.spending_restaurants, s.spending_retail
FROM county_mobility m JOIN spend_pivot s ON m.county_fips = s.county_fips""",
          ("member_ratio", ("spending_restaurants", _BIG), ("spending_retail", _BIG)))
def j01(spark, d):
    mob = context(spark, d).county_mobility().select(
        "county_fips", "total_trips", "member_ratio")
    piv = spending.pivot_spending(context(spark, d).spending()).select(
        "county_fips", "spending_restaurants", "spending_retail")
    return mob.join(piv, "county_fips", "inner")
