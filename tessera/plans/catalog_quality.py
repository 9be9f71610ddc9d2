"""Registered queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import quality
from tessera.oracle.views import cte, with_
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import views

TRIP_COLS = ["trip_id", "start_time", "end_time", "start_station_id", "end_station_id",
             "start_lat", "start_lng", "end_lat", "end_lng", "member_type"]
SPEND_COLS = ["county_fips", "year", "month", "category", "spending_amount", "date"]


# ----------------------------------------------------------- DuckDB twins
def _rule_sql(src: str, dataset: str, rules: list[tuple[str, str, str, str | None]]) -> str:
    aggs = ", ".join(f"CAST({expr} AS BIGINT) AS r{i}" for i, (_, _, expr, _) in enumerate(rules))
    parts = []
    for i, (name, sev, _, flag) in enumerate(rules):
        f = flag or f"r{i} > 0"
        parts.append(f"SELECT '{dataset}' AS dataset, '{name}' AS rule, '{sev}' AS severity, "
                     f"r{i} AS n_bad, {f} AS flagged FROM _agg_{dataset}")
    return (f"SELECT * FROM (WITH _agg_{dataset} AS (SELECT count(*) AS _n, {aggs} FROM {src}) "
            + " UNION ALL ".join(parts) + ")")


_DUR = "(date_diff('second', start_time, end_time) / CAST(60.0 AS DOUBLE))"
_COORD = ("(start_lat < -90 OR start_lat > 90 OR start_lng < -180 OR start_lng > 180 OR "
          "end_lat < -90 OR end_lat > 90 OR end_lng < -180 OR end_lng > 180)")


def _trip_rules_sql(src: str, dataset: str, parse: str = "count_if(false)") -> str:
    rules = [
        ("date_parse_errors", "issue", parse, None),
        ("invalid_coordinates", "warning", f"count_if(coalesce({_COORD}, false))", None),
        ("negative_durations", "issue", f"count_if({_DUR} < 0)", None),
        ("long_trips", "warning", f"count_if({_DUR} > 1440)", None),
        ("short_trips", "warning", f"count_if({_DUR} < 1)", None),
    ] + [(f"nulls:{c}", "warning", f"count_if({c} IS NULL)", None) for c in TRIP_COLS]
    return f"""
SELECT '{dataset}' AS dataset, 'missing_columns' AS rule, 'issue' AS severity, CAST(0 AS BIGINT) AS n_bad,
       false AS flagged
UNION ALL {_rule_sql(src, dataset, rules)}
UNION ALL SELECT '{dataset}', 'invalid_member_types', 'warning', count(*), count(*) > 0
  FROM (SELECT DISTINCT member_type FROM {src}
        WHERE member_type IS NULL OR member_type NOT IN ('member', 'casual')) AS x
UNION ALL SELECT '{dataset}', 'duplicate_ids', 'issue', CAST(coalesce(sum(n - 1), 0) AS BIGINT),
       coalesce(sum(n - 1), 0) > 0
  FROM (SELECT trip_id, count(*) AS n FROM {src} GROUP BY trip_id) AS d"""


cte("trip_rules", _trip_rules_sql("trips_dirty", "trips_dirty"), ("trips_dirty",))

cte("trips_messy", """
SELECT trip_id, try_cast(start_text AS TIMESTAMP) AS start_time, try_cast(end_text AS TIMESTAMP) AS end_time,
       start_text, end_text, start_station_id, end_station_id,
       start_lat + CASE WHEN end_station_id % 7 = 1 THEN 100 ELSE 0 END AS start_lat, start_lng, end_lat, end_lng,
       CASE start_station_id % 13 WHEN 5 THEN 'vip' WHEN 6 THEN NULL ELSE member_type END AS member_type
FROM (SELECT *, CASE WHEN start_station_id % 10 = 3 THEN 'not a date' ELSE CAST(start_time AS VARCHAR) END AS start_text,
             CAST(end_time AS VARCHAR) AS end_text FROM trips) AS x""", ("trips",))
cte("trip_rules_messy", _trip_rules_sql("trips_messy", "trips_messy", """count_if(
  (start_text IS NOT NULL AND start_time IS NULL) OR (end_text IS NOT NULL AND end_time IS NULL))""").replace(
    "count_if(start_time IS NULL)", "count_if(start_text IS NULL)").replace(
    "count_if(end_time IS NULL)", "count_if(end_text IS NULL)"), ("trips_messy",))

_FIPS_BAD = "coalesce(NOT regexp_full_match(CAST(county_fips AS VARCHAR), '\\d{5}'), true)"
def _spending_rules_sql(src: str, dataset: str) -> str:
    return f"""
SELECT '{dataset}' AS dataset, 'missing_columns' AS rule, 'issue' AS severity, CAST(0 AS BIGINT) AS n_bad,
       false AS flagged
UNION ALL {_rule_sql(src, dataset, [
    ('invalid_fips', 'warning', f'count_if({_FIPS_BAD})', None),
    ('unusual_years', 'warning', 'count_if(year < 2020 OR year > 2030)', None),
    ('invalid_months', 'issue', 'count_if(month < 1 OR month > 12)', None),
    ('negative_spending', 'warning', 'count_if(spending_amount < 0)', None),
    ('zero_spending', 'warning', 'count_if(spending_amount = 0)', 'r4 > _n * 0.1'),
    ('extreme_values', 'warning',
     f"count_if(coalesce(spending_amount < (SELECT quantile_cont(spending_amount, 0.25) - 3 * "
     f"(quantile_cont(spending_amount, 0.75) - quantile_cont(spending_amount, 0.25)) FROM {src}) "
     "OR spending_amount > (SELECT quantile_cont(spending_amount, 0.75) + 3 * "
     f"(quantile_cont(spending_amount, 0.75) - quantile_cont(spending_amount, 0.25)) FROM {src}), false))",
     None),
] + [(f'nulls:{c}', 'warning', f'count_if({c} IS NULL)', None) for c in SPEND_COLS])}
UNION ALL SELECT '{dataset}', 'unexpected_categories', 'warning', count(*), count(*) > 0
  FROM (SELECT DISTINCT category FROM {src} WHERE category IS NULL OR category NOT IN
        ('restaurants', 'retail', 'grocery', 'entertainment', 'transportation', 'healthcare',
         'education', 'services')) AS x"""

cte("spending_rules", _spending_rules_sql("spending", "spending"), ("spending",))
cte("spending_messy", """
SELECT CASE WHEN month = 3 THEN 'X' ELSE '' END || county_fips AS county_fips, year,
       CASE WHEN month = 12 THEN 13 ELSE month END AS month,
       CASE WHEN category = 'retail' AND year = 1997 THEN 'gifts' WHEN month = 5 THEN NULL ELSE category END AS category,
       CASE month WHEN 7 THEN -spending_amount WHEN 8 THEN 0.0 ELSE spending_amount END AS spending_amount, date
FROM spending""", ("spending",))
cte("spending_rules_messy", _spending_rules_sql("spending_messy", "spending_messy"), ("spending_messy",))

cte("boundary_rules", f"""
SELECT 'boundaries' AS dataset, 'missing_columns' AS rule, 'issue' AS severity, CAST(0 AS BIGINT) AS n_bad,
       false AS flagged
UNION ALL {_rule_sql('bnd', 'boundaries', [
    ('invalid_geometry', 'issue', 'count_if(false)', None),
    ('empty_geometry', 'warning', 'count_if(false)', None),
    ('missing_crs', 'warning', 'count_if(false)', None),
    ('non_wgs84_crs', 'warning', 'count_if(false)', None),
    ('invalid_fips', 'warning', f'count_if({_FIPS_BAD})', None),
])}""", ("bnd",))


# what each fault of the messy boundaries leaves, counted by the key that put it there
cte("boundary_rules_messy", f"""
SELECT 'boundaries_messy' AS dataset, 'missing_columns' AS rule, 'issue' AS severity, CAST(0 AS BIGINT) AS n_bad,
       false AS flagged
UNION ALL {_rule_sql('nation', 'boundaries_messy', [
    ('invalid_geometry', 'issue', 'count_if(n_nationkey % 5 = 1)', None),
    ('empty_geometry', 'warning', 'count_if(n_nationkey % 5 = 2)', None),
    ('missing_crs', 'warning', 'count_if(n_nationkey % 4 = 0)', None),
    ('non_wgs84_crs', 'warning', 'count_if(n_nationkey % 4 = 1)', None),
    ('invalid_fips', 'warning', 'count_if(n_nationkey % 6 = 5)', None),
])}""")


# --------------------------------------------------------------- queries
def _trip_rules(spark, d):
    return quality.trip_rules(views.trips_dirty(spark, d), "trips_dirty")


def _rule_query(key, rules_fn, cte_name, names, like=False):
    cond_sql = (" OR ".join(f"rule LIKE '{n}'" for n in names) if like
                else "rule IN (" + ", ".join(f"'{n}'" for n in names) + ")")

    def fn(spark, d):
        r = rules_fn(spark, d)
        cond = None
        for n in names:
            c = F.col("rule").like(n) if like else (F.col("rule") == n)
            cond = c if cond is None else (cond | c)
        return r.where(cond)
    fn.__name__ = key
    register(key, with_(cte_name) + f"SELECT * FROM {cte_name} WHERE {cond_sql}")(fn)


def _spending_rules(spark, d):
    return quality.spending_rules(context(spark, d).spending())


def _boundary_rules(spark, d):
    return quality.boundary_rules(views.boundaries(spark, d))


def _all_rules(spark, d):
    return (_trip_rules(spark, d).unionByName(_spending_rules(spark, d))
            .unionByName(_boundary_rules(spark, d)))


_rule_query("b02_date_parse_check", _trip_rules, "trip_rules", ["date_parse_errors"])
_rule_query("b03_null_counts", _trip_rules, "trip_rules", ["nulls:%"], like=True)
_rule_query("b04_coordinate_bounds", _trip_rules, "trip_rules", ["invalid_coordinates"])
_rule_query("b05_negative_duration", _trip_rules, "trip_rules", ["negative_durations"])
_rule_query("b06_long_short_trips", _trip_rules, "trip_rules", ["long_trips", "short_trips"])
_rule_query("b08_member_type_domain", _trip_rules, "trip_rules", ["invalid_member_types"])
_rule_query("b09_duplicate_ids", _trip_rules, "trip_rules", ["duplicate_ids"])
_rule_query("b10_fips_format", _spending_rules, "spending_rules", ["invalid_fips"])
_rule_query("b11_year_month_range", _spending_rules, "spending_rules", ["unusual_years", "invalid_months"])
_rule_query("b12_negative_zero_spending", _spending_rules, "spending_rules",
            ["negative_spending", "zero_spending"])
_rule_query("b13_extreme_values_iqr3", _spending_rules, "spending_rules", ["extreme_values"])
_rule_query("b15_category_domain", _spending_rules, "spending_rules", ["unexpected_categories"])
_rule_query("b16_geometry_valid_empty", _boundary_rules, "boundary_rules",
            ["invalid_geometry", "empty_geometry"])
_rule_query("b17_crs_check", _boundary_rules, "boundary_rules", ["missing_crs", "non_wgs84_crs"])


@register("b01_required_columns", with_("trips", "spending", "bnd") + """
SELECT 'trips' AS dataset, CAST(0 AS BIGINT) AS missing, (SELECT count(*) FROM trips) AS total_records,
       true AS passed
UNION ALL SELECT 'trips_partial', 7, (SELECT count(*) FROM trips), false
UNION ALL SELECT 'spending', 0, (SELECT count(*) FROM spending), true
UNION ALL SELECT 'boundaries', 0, (SELECT count(*) FROM bnd), true""")
def b01(spark, d):
    """Required columns per dataset; a two-column projection of trips
    (the reference's own failing case) misses seven."""
    t = views.trips(spark, d)
    sets = [("trips", t, quality.TRIP_REQUIRED),
            ("trips_partial", t.select("trip_id", "start_time"), quality.TRIP_REQUIRED),
            ("spending", context(spark, d).spending(), quality.SPENDING_REQUIRED),
            ("boundaries", views.boundaries(spark, d), quality.BOUNDARY_REQUIRED)]
    out = None
    for name, df, req in sets:
        miss = len(quality.missing_columns(df, req))
        row = df.agg(F.count(F.lit(1)).alias("total_records")).select(
            F.lit(name).alias("dataset"), F.lit(miss).cast("long").alias("missing"),
            "total_records", F.lit(miss == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


@register("b07_duration_statistics", with_("trips_dirty") + f"""
SELECT avg(d) AS mean_minutes, median(d) AS median_minutes, stddev_samp(d) AS std_minutes,
       min(d) AS min_minutes, max(d) AS max_minutes
FROM (SELECT {_DUR} AS d FROM trips_dirty) AS x""",
          ("mean_minutes", "median_minutes", "std_minutes", "min_minutes", "max_minutes"))
def b07(spark, d):
    return quality.duration_stats(views.trips_dirty(spark, d))


@register("b14_spending_statistics", with_("spending") + """
SELECT avg(spending_amount) AS mean, median(spending_amount) AS median,
       stddev_samp(spending_amount) AS std, min(spending_amount) AS min, max(spending_amount) AS max
FROM spending""", ("mean", "median", "std", "min", "max"))
def b14(spark, d):
    return quality.spending_stats(context(spark, d).spending())


@register("b18_quality_report", with_("trip_rules", "spending_rules", "boundary_rules", "spending", "bnd",
                                      "trips_dirty") + """
SELECT coalesce(r.dataset, 'ALL') AS dataset,
       CAST(sum(CASE WHEN r.rule = 'missing_columns' THEN c.total_records END) AS BIGINT) AS total_records,
       CAST(count_if(r.severity = 'issue' AND r.flagged) AS BIGINT) AS issues,
       CAST(count_if(r.severity = 'warning' AND r.flagged) AS BIGINT) AS warnings,
       CASE WHEN count_if(r.severity = 'issue' AND r.flagged) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
       coalesce(max(CASE WHEN r.rule = 'missing_columns' THEN r.n_bad END), 0) = 0 AS passed
FROM (SELECT * FROM trip_rules UNION ALL SELECT * FROM spending_rules UNION ALL SELECT * FROM boundary_rules) r
JOIN (SELECT 'trips_dirty' AS dataset, count(*) AS total_records FROM trips_dirty
      UNION ALL SELECT 'spending', count(*) FROM spending
      UNION ALL SELECT 'boundaries', count(*) FROM bnd) c ON r.dataset = c.dataset
GROUP BY ROLLUP (r.dataset)""")
def b18(spark, d):
    counts = (views.trips_dirty(spark, d).agg(F.count(F.lit(1)).alias("total_records"))
              .select(F.lit("trips_dirty").alias("dataset"), "total_records")
              .unionByName(context(spark, d).spending().agg(F.count(F.lit(1)).alias("total_records"))
                           .select(F.lit("spending").alias("dataset"), "total_records"))
              .unionByName(views.boundaries(spark, d).agg(F.count(F.lit(1)).alias("total_records"))
                           .select(F.lit("boundaries").alias("dataset"), "total_records")))
    return quality.quality_report(_all_rules(spark, d), counts)


@register("b19_spatial_validation", with_("assigned", "bnd") + """
SELECT count(*) AS total_stations, count_if(county_fips IS NULL) AS unassigned_stations,
       count_if(coalesce(lat < -90 OR lat > 90 OR lng < -180 OR lng > 180, false)) AS invalid_coordinates,
       (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT station_id, count(*) AS n FROM assigned
        GROUP BY station_id) AS x) AS duplicate_stations,
       (SELECT count(*) FROM bnd WHERE county_fips NOT IN
          (SELECT county_fips FROM assigned WHERE county_fips IS NOT NULL)) AS counties_without_stations,
       (SELECT avg(n) FROM (SELECT county_fips, count(*) AS n FROM assigned WHERE county_fips IS NOT NULL
        GROUP BY county_fips) AS y) AS stations_per_county_mean,
       (SELECT min(n) FROM (SELECT county_fips, count(*) AS n FROM assigned WHERE county_fips IS NOT NULL
        GROUP BY county_fips) AS y) AS stations_per_county_min,
       (SELECT max(n) FROM (SELECT county_fips, count(*) AS n FROM assigned WHERE county_fips IS NOT NULL
        GROUP BY county_fips) AS y) AS stations_per_county_max,
       count_if(county_fips IS NULL) = 0
         AND count_if(coalesce(lat < -90 OR lat > 90 OR lng < -180 OR lng > 180, false)) = 0 AS passed
FROM assigned""", ("stations_per_county_mean",))
def b19(spark, d):
    prepared = context(spark, d).prepared()
    return quality.spatial_validation(context(spark, d).assigned(), prepared)


@register("b20_detect_outliers_iqr", with_("spending") + """
SELECT county_fips, year, month, category, spending_amount,
       coalesce(spending_amount < q1 - 1.5 * (q3 - q1) OR spending_amount > q3 + 1.5 * (q3 - q1), false)
         AS spending_amount_outlier
FROM spending, (SELECT quantile_cont(spending_amount, 0.25) AS q1, quantile_cont(spending_amount, 0.75) AS q3
                FROM spending) AS q""", ("spending_amount",))
def b20(spark, d):
    s = context(spark, d).spending().drop("date")
    return quality.iqr_outliers(s, ["spending_amount"], 1.5)


@register("b21_detect_outliers_zscore", with_("spending") + """
SELECT county_fips, year, month, category, spending_amount,
       coalesce(abs((spending_amount - m) / nullif(s, 0)) > 3.0, false) AS spending_amount_outlier,
       coalesce(abs((spending_amount - m) / nullif(s, 0)) > 3.0, false) AS any_outlier
FROM spending, (SELECT avg(spending_amount) AS m, stddev_samp(spending_amount) AS s FROM spending) AS q""",
          ("spending_amount",))
def b21(spark, d):
    s = context(spark, d).spending().drop("date")
    return quality.zscore_outliers(s, ["spending_amount"], 3.0)


def _summary_sql() -> str:
    num = ["year", "month", "spending_amount"]
    parts = []
    for c, t in [("county_fips", "string"), ("year", "int"), ("month", "int"),
                 ("category", "string"), ("spending_amount", "double")]:
        stats = (f"avg(CAST({c} AS DOUBLE)), median(CAST({c} AS DOUBLE)), stddev_samp(CAST({c} AS DOUBLE)), "
                 f"min(CAST({c} AS DOUBLE)), max(CAST({c} AS DOUBLE))" if c in num
                 else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE")
        top = ("NULL::VARCHAR" if c in num else
               f"(SELECT string_agg(v || ':' || CAST(cnt AS VARCHAR), ',' ORDER BY cnt DESC, v ASC) FROM "
               f"(SELECT {c} AS v, count(*) AS cnt FROM s0 WHERE {c} IS NOT NULL GROUP BY {c} "
               f"ORDER BY cnt DESC, v ASC LIMIT 5) AS t)")
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count_if({c} IS NULL) AS null_count, "
                     f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values, {stats}, {top} AS top_values FROM s0")
    body = " UNION ALL ".join(parts)
    return (with_("spending") + ", s0 AS (SELECT county_fips, year, month, category, spending_amount FROM spending) "
            "SELECT column_name, dtype, null_count, unique_values, m1 AS mean, m2 AS median, m3 AS std, m4 AS min, "
            f"m5 AS max, top_values FROM ({body}) AS u(column_name, dtype, null_count, unique_values, m1, m2, m3, m4, "
            "m5, top_values)")


@register("b22_data_summary", _summary_sql(), ("mean", "median", "std", "min", "max"))
def b22(spark, d):
    s = context(spark, d).spending().select("county_fips", "year", "month", "category", "spending_amount")
    return quality.data_summary(s)


_ALL_TRIP = ", ".join(TRIP_COLS)


@register("b24_sample_rows", with_("trips") + f"""
SELECT {_ALL_TRIP} FROM trips ORDER BY trip_id, start_time, end_time, start_station_id, end_station_id, member_type
LIMIT 1000""")
def b24(spark, d):
    t = views.trips(spark, d)
    return t.orderBy("trip_id", "start_time", "end_time", "start_station_id", "end_station_id",
                     "member_type").limit(1000)


@register("b02_b04_b08_rules_on_messy_trips", with_("trip_rules_messy") + "SELECT * FROM trip_rules_messy")
def b02_messy(spark, d):
    """All trip rules on trips with known faults: unreadable times, latitudes out of range, unknown member types."""
    return quality.trip_rules(views.trips_messy(spark, d), "trips_messy")


@register("b10_b15_rules_on_messy_spending", with_("spending_rules_messy") + "SELECT * FROM spending_rules_messy")
def b10_messy(spark, d):
    """All spending rules on spending with known faults."""
    return quality.spending_rules(views.spending_messy(context(spark, d).spending()), "spending_messy")


@register("b16_b17_rules_on_messy_boundaries", with_("boundary_rules_messy") + "SELECT * FROM boundary_rules_messy")
def b16_messy(spark, d):
    """All boundary rules on boundaries with known faults."""
    return quality.boundary_rules(views.boundaries_messy(spark, d), "boundaries_messy")
