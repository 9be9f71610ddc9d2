"""Registered queries: personas, opportunities, insights and dashboard
rollups (N01-N12, O01-O06, H07, H08, T02, T03, T07-T10, D01-D10, D16-D18,
F10-F12, F14, F16-F18).  Profiles come from K09 over the fixed labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.bands import pct_of_max, rescale_unit
from tessera.operators import metrics, personas as P
from tessera.oracle.views import cte, with_
from tessera.plans import catalog_cluster as CC
from tessera.plans.context import context
from tessera.plans.registry import register
from tessera.sources import views


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- Spark side
def personas_of(spark, d, labels):
    """K09 → N12: the personas of a clustering of the counties."""
    prof = metrics.cluster_profiles(CC.raw_long(spark, d), labels, "county_fips")
    top = metrics.distinguishing_features(prof, 5)
    return P.generate_personas(prof, top, labels, views.demographics(spark, d))


def persona_table(spark, d):
    return context(spark, d)._keep("personas", lambda: personas_of(spark, d, views.assignments(spark, d)))


def opportunity_table(spark, d):
    ctx = context(spark, d)
    return ctx._keep("opportunities", lambda: P.opportunities(persona_table(spark, d)))


# ---------------------------------------------------------------- DuckDB side
cte("demographics", """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county_fips, 40000.0 + median(c_acctbal) AS median_income,
       avg(CAST(c_mktsegment = 'AUTOMOBILE' AS DOUBLE)) AS age_18_34_pct,
       avg(CAST(c_mktsegment = 'BUILDING' AS DOUBLE)) AS age_35_54_pct,
       avg(CAST(c_mktsegment = 'FURNITURE' AS DOUBLE)) AS age_55_plus_pct,
       avg(CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE)) AS bachelor_plus_pct,
       avg(CAST(c_mktsegment = 'MACHINERY' AS DOUBLE)) AS high_school_pct
FROM customer GROUP BY c_nationkey""")

cte("prof", """
SELECT l.cluster, r.feature, avg(r.value) AS mean FROM raw_long r JOIN labels l ON r.county_fips = l.county_fips
GROUP BY l.cluster, r.feature""", ("raw_long", "labels"))

cte("top5", """
SELECT cluster, feature, z_score FROM (
  SELECT p.cluster, p.feature, (p.mean - o.mu) / nullif(o.sd, 0) AS z_score,
         row_number() OVER (PARTITION BY p.cluster ORDER BY abs((p.mean - o.mu) / nullif(o.sd, 0)) DESC,
                            p.feature) AS rk
  FROM prof p JOIN (SELECT r.feature, avg(r.value) AS mu, stddev_samp(r.value) AS sd
                    FROM raw_long r JOIN labels l ON r.county_fips = l.county_fips GROUP BY r.feature) o
    ON p.feature = o.feature
  WHERE (p.mean - o.mu) / nullif(o.sd, 0) IS NOT NULL) AS q WHERE rk <= 5""", ("prof",))


def _band(x, hi, mid, labels=("high", "medium", "low")):
    return f"CASE WHEN {x} > {hi} THEN '{labels[0]}' WHEN {x} > {mid} THEN '{labels[1]}' ELSE '{labels[2]}' END"


cte("traits", "SELECT pm.*, s.size, s.members, "
    + _band("total_trips", 8000, 3000) + " AS usage_intensity, "
    + _band("avg_trip_duration_minutes", 20, 12, ("long", "medium", "short")) + " AS trip_length_preference, "
    + _band("member_ratio", 0.7, 0.4) + " AS membership_commitment, "
    + _band("weekend_ratio", 0.4, 0.25) + " AS weekend_usage, "
    + _band("peak_hour_ratio", 0.35, 0.25, ("strong", "moderate", "weak")) + " AS commuter_pattern, "
    + _band("total_spending", 800000, 400000) + " AS spending_level, "
    + _band("spending_pct_restaurants", 0.25, 0.15) + " AS dining_preference, "
    + _band("spending_pct_retail", 0.3, 0.2) + " AS retail_orientation, "
    + _band("spending_pct_entertainment", 0.15, 0.08) + " AS entertainment_focus, "
    + _band("discretionary_ratio", 0.6, 0.4) + " AS discretionary_spending, "
    + "CASE WHEN peak_hour_ratio > 0.35 THEN 'structured' ELSE 'flexible' END AS schedule_type, "
    + _band("weekend_ratio", 0.35, 0.25, ("active", "moderate", "inactive")) + " AS weekend_activity, "
    + _band("night_trips_ratio", 0.15, 0.05, ("frequent", "occasional", "rare")) + " AS night_usage, "
    + _band("seasonal_variation", 0.3, 0.15) + " AS seasonal_sensitivity "
    + "FROM (SELECT cluster, " + ", ".join(
        f"max(mean) FILTER (WHERE feature = '{f}') AS {f}" for f in P.TRAIT_FEATURES)
    + " FROM prof WHERE cluster <> -1 GROUP BY cluster) pm JOIN (SELECT cluster, count(*) AS size, "
      "list_sort(list(county_fips)) AS members FROM labels GROUP BY cluster) s ON pm.cluster = s.cluster",
    ("prof", "labels"))

_TYPE = """CASE
  WHEN commuter_pattern = 'strong' AND membership_commitment = 'high' AND schedule_type = 'structured'
    THEN 'Urban Commuter'
  WHEN weekend_activity = 'active' AND schedule_type = 'flexible' AND usage_intensity IN ('medium', 'high')
    THEN 'Leisure Cyclist'
  WHEN membership_commitment = 'low' AND trip_length_preference = 'short' AND entertainment_focus = 'high'
    THEN 'Tourist Explorer'
  WHEN trip_length_preference = 'long' AND weekend_activity = 'active' AND usage_intensity = 'high'
    THEN 'Fitness Enthusiast'
  WHEN spending_level = 'high' AND discretionary_spending = 'high' THEN 'Premium Consumer'
  WHEN spending_level = 'low' AND discretionary_spending = 'low' THEN 'Budget Conscious'
  WHEN membership_commitment = 'high' AND retail_orientation = 'high' THEN 'Tech Savvy'
  ELSE 'Family Oriented' END"""
cte("typed", f"SELECT *, {_TYPE} AS persona_type FROM traits", ("traits",))

_BASE = "CASE persona_type " + " ".join(
    f"WHEN {_q(k)} THEN [{', '.join(_q(n) for n in v)}][(cluster % 3) + 1]" for k, v in P.BASE_NAMES.items()) + " END"
_DESC = "CASE persona_type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in P.DESCRIPTIONS.items()) \
    + f" ELSE {_q(P.DEFAULT_DESCRIPTION)} END"
_VPU = "CASE spending_level WHEN 'high' THEN 500.0 WHEN 'medium' THEN 200.0 ELSE 100.0 END"
_MULT = "CASE membership_commitment WHEN 'high' THEN 1.5 WHEN 'medium' THEN 1.2 WHEN 'low' THEN 0.8 ELSE 1.0 END"


def _season(season: str) -> str:
    base = P.SEASON_BASE[season]
    adj = "+ seasonal_variation" if season in ("spring", "summer") else "- seasonal_variation * 0.5"
    return f"least(greatest({base} {adj}, 0.3), 1.8)"


cte("personas", f"""
SELECT 'persona_' || CAST(t.cluster AS VARCHAR) AS persona_id, t.cluster AS cluster_id, t.persona_type,
       concat_ws(' ', CASE t.usage_intensity WHEN 'high' THEN 'Power' WHEN 'low' THEN 'Casual' ELSE 'Regular' END,
                 coalesce({_BASE.replace('cluster', 't.cluster').replace('persona_type', 't.persona_type')},
                          'Generic User')) AS persona_name,
       t.size AS estimated_population, t.members,
       round(CAST(t.size AS DOUBLE) * ({_VPU.replace('spending_level', 't.spending_level')})
             * ({_MULT.replace('membership_commitment', 't.membership_commitment')}), 2) AS market_value,
       coalesce(e.te, 0.5) AS targeting_effectiveness,
       {_season('spring')} AS spring, {_season('summer')} AS summer, {_season('fall')} AS fall,
       {_season('winter')} AS winter,
       {_DESC.replace('persona_type', 't.persona_type')} AS description,
       t.usage_intensity, t.trip_length_preference, t.membership_commitment, t.weekend_usage, t.commuter_pattern,
       t.spending_level, t.dining_preference, t.retail_orientation, t.entertainment_focus, t.discretionary_spending,
       t.schedule_type, t.weekend_activity, t.night_usage, t.seasonal_sensitivity,
       t.spending_pct_restaurants, t.spending_pct_retail, t.spending_pct_entertainment
FROM typed t LEFT JOIN (SELECT cluster, round(least(avg(abs(z_score)) / 2.0, 1.0), 3) AS te FROM top5
                        GROUP BY cluster) e ON t.cluster = e.cluster""", ("typed", "top5"))

_RULES = " UNION ALL ".join(
    f"SELECT {_q(t)} AS opportunity_type, {_q(pt) if pt else 'NULL'} AS persona_type, {_q(desc)} AS description, "
    f"{_q(inv)} AS investment_level, {_q(roi)} AS expected_roi, {_q(tl)} AS implementation_timeline, "
    f"{_q(', '.join(m))} AS key_metrics, {i} AS rule_order"
    for i, (t, pt, desc, inv, roi, tl, m) in enumerate(P.OPPORTUNITY_RULES))
cte("opp_rules", _RULES)
cte("opportunities", """
SELECT h.opportunity_type, r.description, string_agg(h.persona_name, ', ' ORDER BY h.cluster_id) AS target_segments,
       round(sum(h.market_value), 2) AS estimated_market_size, r.investment_level, r.expected_roi,
       r.implementation_timeline, r.key_metrics, CAST(r.rule_order AS BIGINT) AS rule_order
FROM (SELECT 'Market Expansion' AS opportunity_type, cluster_id, persona_name, market_value FROM personas
      WHERE market_value > (SELECT avg(market_value) FROM personas)
      UNION ALL
      SELECT r.opportunity_type, p.cluster_id, p.persona_name, p.market_value
      FROM personas p JOIN opp_rules r ON p.persona_type = r.persona_type) h
JOIN opp_rules r ON h.opportunity_type = r.opportunity_type
GROUP BY h.opportunity_type, r.description, r.investment_level, r.expected_roi, r.implementation_timeline,
         r.key_metrics, r.rule_order""", ("personas", "opp_rules"))


def _flat(p):
    """Personas with arrays / maps flattened for comparison."""
    st = F.col("seasonal_trends")
    return p.select("persona_id", "cluster_id", "persona_type", "persona_name", "estimated_population",
                    F.array_join("members", ",").alias("members"), "market_value", "targeting_effectiveness",
                    st["spring"].alias("spring"), st["summer"].alias("summer"), st["fall"].alias("fall"),
                    st["winter"].alias("winter"))


_SEASONS = ("spring", "summer", "fall", "winter")


@register("n01_mobility_traits", with_("typed") + """
SELECT cluster, usage_intensity, trip_length_preference, membership_commitment, weekend_usage, commuter_pattern
FROM typed""")
def n01(spark, d):
    t = P.cluster_traits(metrics.cluster_profiles(CC.raw_long(spark, d), views.assignments(spark, d), "county_fips"),
                         views.assignments(spark, d))
    return t.select("cluster", "usage_intensity", "trip_length_preference", "membership_commitment",
                    "weekend_usage", "commuter_pattern")


@register("n02_spending_traits", with_("typed") + """
SELECT cluster, spending_level, dining_preference, retail_orientation, entertainment_focus, discretionary_spending
FROM typed""")
def n02(spark, d):
    t = P.cluster_traits(metrics.cluster_profiles(CC.raw_long(spark, d), views.assignments(spark, d), "county_fips"),
                         views.assignments(spark, d))
    return t.select("cluster", "spending_level", "dining_preference", "retail_orientation", "entertainment_focus",
                    "discretionary_spending")


@register("n03_temporal_traits", with_("typed") + """
SELECT cluster, schedule_type, weekend_activity, night_usage, seasonal_sensitivity FROM typed""")
def n03(spark, d):
    t = P.cluster_traits(metrics.cluster_profiles(CC.raw_long(spark, d), views.assignments(spark, d), "county_fips"),
                         views.assignments(spark, d))
    return t.select("cluster", "schedule_type", "weekend_activity", "night_usage", "seasonal_sensitivity")


@register("n05_cluster_characteristics", with_("typed") + """
SELECT cluster, size, array_to_string(members, ',') AS members, persona_type FROM typed""")
def n05(spark, d):
    t = P.cluster_traits(metrics.cluster_profiles(CC.raw_long(spark, d), views.assignments(spark, d), "county_fips"),
                         views.assignments(spark, d))
    return t.select("cluster", "size", F.array_join("members", ",").alias("members"), "persona_type")


@register("n04_determine_persona_type", with_("personas") + "SELECT cluster_id, persona_type FROM personas")
def n04(spark, d):
    return persona_table(spark, d).select("cluster_id", "persona_type")


@register("n06_demographic_profile", with_("typed", "demographics") + """
SELECT t.cluster AS cluster_id, coalesce(avg(d.median_income), 65000.0) AS median_income,
       coalesce(avg(d.age_18_34_pct), 0.3) AS age_18_34, coalesce(avg(d.age_35_54_pct), 0.4) AS age_35_54,
       coalesce(avg(d.age_55_plus_pct), 0.3) AS age_55_plus, coalesce(avg(d.bachelor_plus_pct), 0.4) AS bachelor_plus,
       coalesce(avg(d.high_school_pct), 0.6) AS high_school
FROM (SELECT cluster, unnest(members) AS county_fips FROM typed) t LEFT JOIN demographics d
  ON t.county_fips = d.county_fips GROUP BY t.cluster""",
          (("median_income", 4), "age_18_34", "age_35_54", "age_55_plus", "bachelor_plus", "high_school"))
def n06(spark, d):
    return persona_table(spark, d).select("cluster_id", "median_income", "age_18_34", "age_35_54", "age_55_plus",
                                          "bachelor_plus", "high_school")


@register("n07_persona_description", with_("personas") + "SELECT persona_id, persona_type, description FROM personas")
def n07(spark, d):
    return persona_table(spark, d).select("persona_id", "persona_type", "description")


@register("n08_persona_name", with_("personas") + "SELECT persona_id, persona_name FROM personas")
def n08(spark, d):
    return persona_table(spark, d).select("persona_id", "persona_name")


@register("n09_market_value", with_("personas") + """
SELECT persona_id, estimated_population, market_value FROM personas""", ("market_value",))
def n09(spark, d):
    return persona_table(spark, d).select("persona_id", "estimated_population", "market_value")


@register("n10_targeting_effectiveness", with_("personas") + """
SELECT persona_id, targeting_effectiveness FROM personas""", ("targeting_effectiveness",))
def n10(spark, d):
    return persona_table(spark, d).select("persona_id", "targeting_effectiveness")


@register("n11_seasonal_trends", with_("personas") + """
SELECT persona_id, spring, summer, fall, winter FROM personas""", _SEASONS)
def n11(spark, d):
    return _flat(persona_table(spark, d)).select("persona_id", *_SEASONS)


@register("n12_persona_narratives", with_("personas") + """
SELECT persona_id, cluster_id, persona_type, persona_name, estimated_population,
       array_to_string(members, ',') AS members, market_value, targeting_effectiveness, spring, summer, fall, winter
FROM personas""", ("market_value", "targeting_effectiveness") + _SEASONS)
def n12(spark, d):
    return _flat(persona_table(spark, d))


@register("o01_o02_business_opportunities", with_("opportunities") + "SELECT * FROM opportunities",
          ("estimated_market_size",))
def o01(spark, d):
    o = opportunity_table(spark, d)
    return o.select("opportunity_type", "description", F.array_join("target_segments", ", ").alias("target_segments"),
                    "estimated_market_size", "investment_level", "expected_roi", "implementation_timeline",
                    F.array_join("key_metrics", ", ").alias("key_metrics"), "rule_order")


@register("o03_market_overview", with_("personas") + """
SELECT sum(market_value) AS total_addressable_market, sum(estimated_population) AS total_population,
       avg(targeting_effectiveness) AS average_targeting_effectiveness, count(*) AS number_of_segments
FROM personas""", ("total_addressable_market", "average_targeting_effectiveness"))
def o03(spark, d):
    return P.market_overview(persona_table(spark, d))


def _flags_sql(texts, conds):
    return " UNION ALL ".join(f"SELECT {_q(t)} AS x, {i} AS o WHERE {c}" for i, (t, c) in enumerate(zip(texts, conds)))


@register("o04_strategic_recommendations", with_("personas") + ", s AS (SELECT "
          "count_if(market_value > 100000) / count(*) AS hv, avg(summer - winter) AS sw, "
          "count_if(persona_type = 'Tech Savvy') AS tech, sum(market_value) AS total FROM personas) "
          "SELECT x AS recommendation FROM (" + _flags_sql(P.RECOMMENDATIONS, [
              "(SELECT hv FROM s) > 0.4", "(SELECT sw FROM s) > 0.3", "(SELECT tech FROM s) > 0",
              "(SELECT total FROM s) > 500000"]) + ") AS r")
def o04(spark, d):
    return P.recommendations(persona_table(spark, d))


@register("o05_market_risks", with_("personas") + ", s AS (SELECT "
          "max(estimated_population) / sum(estimated_population) AS ms, avg(winter) AS w, "
          "count_if(persona_type = 'Tech Savvy') / count(*) AS ts, "
          "sum(CASE WHEN persona_type = 'Budget Conscious' THEN estimated_population ELSE 0 END) "
          "/ sum(estimated_population) AS bs FROM personas) "
          "SELECT x AS risk FROM (" + _flags_sql(P.RISKS, [
              "(SELECT ms FROM s) > 0.5", "(SELECT w FROM s) < 0.6", "(SELECT ts FROM s) > 0.3",
              "(SELECT bs FROM s) > 0.3"]) + ") AS r")
def o05(spark, d):
    return P.risks(persona_table(spark, d))


@register("o06_key_insights", with_("personas") + """
SELECT first(persona_name ORDER BY market_value DESC, cluster_id) AS highest_value_persona,
       max(market_value) AS highest_market_value,
       first(persona_name ORDER BY targeting_effectiveness DESC, cluster_id) AS best_targeting_persona,
       max(targeting_effectiveness) AS best_targeting_effectiveness,
       first(persona_name ORDER BY summer DESC, cluster_id) AS best_summer_persona,
       sum(CASE WHEN persona_type = 'Urban Commuter' THEN market_value END) AS commuter_market_value
FROM personas""", ("highest_market_value", "best_targeting_effectiveness", "commuter_market_value"))
def o06(spark, d):
    return P.key_insights(persona_table(spark, d))


@register("h07_population_by_persona_type", with_("personas") + """
SELECT persona_type, sum(estimated_population) AS population FROM personas GROUP BY persona_type""")
def h07(spark, d):
    return P.population_by_type(persona_table(spark, d))


@register("h08_seasonal_pattern_stats", with_("personas") + " UNION ALL ".join(
    f"SELECT '{s}' AS season, avg({s}) AS avg_multiplier, stddev_pop({s}) AS variation FROM personas"
    for s in _SEASONS), ("avg_multiplier", "variation"))
def h08(spark, d):
    return P.seasonal_patterns(persona_table(spark, d))


@register("t02_top3_personas_by_value", with_("personas") + """
SELECT persona_id, persona_name, market_value FROM personas ORDER BY market_value DESC, cluster_id LIMIT 3""",
          ("market_value",))
def t02(spark, d):
    return (persona_table(spark, d).orderBy(F.desc("market_value"), F.asc("cluster_id")).limit(3)
            .select("persona_id", "persona_name", "market_value"))


@register("t03_top3_opportunities_by_size", with_("opportunities") + """
SELECT opportunity_type, estimated_market_size FROM opportunities
ORDER BY estimated_market_size DESC, rule_order LIMIT 3""", ("estimated_market_size",))
def t03(spark, d):
    return (opportunity_table(spark, d).orderBy(F.desc("estimated_market_size"), F.asc("rule_order")).limit(3)
            .select("opportunity_type", "estimated_market_size"))


@register("t07_argmax_persona", with_("personas") + """
SELECT first(persona_name ORDER BY market_value DESC, cluster_id) AS best_value_persona,
       first(persona_name ORDER BY targeting_effectiveness DESC, cluster_id) AS best_effectiveness_persona,
       first(persona_name ORDER BY estimated_population DESC, cluster_id) AS largest_persona FROM personas""")
def t07(spark, d):
    p = persona_table(spark, d)
    neg = -F.col("cluster_id")
    return p.agg(F.max_by("persona_name", F.struct("market_value", neg)).alias("best_value_persona"),
                 F.max_by("persona_name", F.struct("targeting_effectiveness", neg)).alias("best_effectiveness_persona"),
                 F.max_by("persona_name", F.struct("estimated_population", neg)).alias("largest_persona"))


@register("t08_peak_season_per_persona", with_("personas") + """
SELECT persona_id, first(season ORDER BY m DESC, o) AS peak_season FROM (
""" + " UNION ALL ".join(f"SELECT persona_id, '{s}' AS season, {s} AS m, {i} AS o FROM personas"
                         for i, s in enumerate(_SEASONS)) + ") AS x GROUP BY persona_id")
def t08(spark, d):
    """Season with the largest multiplier (first in spring-summer-fall-winter
    order on ties), title-cased for display in D03 (F18)."""
    p = persona_table(spark, d)
    order = F.create_map(*[x for i, s in enumerate(_SEASONS) for x in (F.lit(s), F.lit(i))])
    ex = p.select("persona_id", F.explode("seasonal_trends").alias("season", "m"))
    return ex.groupBy("persona_id").agg(
        F.max_by("season", F.struct("m", -F.element_at(order, F.col("season")))).alias("peak_season"))


@register("t10_best_summer_persona", with_("personas") + """
SELECT first(persona_name ORDER BY summer DESC, cluster_id) AS best_summer_persona FROM personas""")
def t10(spark, d):
    p = persona_table(spark, d)
    return p.agg(F.max_by("persona_name", F.struct(F.col("seasonal_trends")["summer"], -F.col("cluster_id")))
                 .alias("best_summer_persona"))


_ROI_LO = "TRY_CAST(split_part(replace(expected_roi, '%', ''), '-', 1) AS DOUBLE)"
_ROI_HI = ("CASE WHEN len(string_split(replace(expected_roi, '%', ''), '-')) >= 2 "
           "THEN TRY_CAST(split_part(replace(expected_roi, '%', ''), '-', 2) AS DOUBLE) ELSE " + _ROI_LO + " END")


@register("f10_roi_range_parse", with_("opportunities") + f"""
SELECT opportunity_type, expected_roi, {_ROI_LO} AS roi_low, {_ROI_HI} AS roi_high,
       ({_ROI_LO} + {_ROI_HI}) / 2.0 AS roi_mid FROM opportunities""", ("roi_low", "roi_high", "roi_mid"))
def f10(spark, d):
    o = opportunity_table(spark, d)
    lo, hi, mid = text.roi_range(F.col("expected_roi"))
    return o.select("opportunity_type", "expected_roi", lo.alias("roi_low"), hi.alias("roi_high"),
                    mid.alias("roi_mid"))


_MONTHS = ("CASE WHEN NOT contains(lower(implementation_timeline), 'month') THEN 12 "
           "WHEN regexp_extract(implementation_timeline, '^\\s*(\\d+)', 1) <> '' "
           "THEN CAST(regexp_extract(implementation_timeline, '^\\s*(\\d+)', 1) AS INTEGER) ELSE 12 END")
_SCORE = "CASE investment_level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 2 END"


@register("f11_f12_d09_priority_matrix", with_("opportunities") + f"""
SELECT opportunity_type, {_ROI_LO} AS roi_low, CAST({_MONTHS} AS BIGINT) AS timeline_months,
       CAST({_SCORE} AS BIGINT) AS investment_score FROM opportunities""", ("roi_low",))
def f11(spark, d):
    o = opportunity_table(spark, d)
    lo, _, _ = text.roi_range(F.col("expected_roi"))
    return o.select("opportunity_type", lo.alias("roi_low"),
                    text.timeline_months(F.col("implementation_timeline")).alias("timeline_months"),
                    text.investment_score(F.col("investment_level")).alias("investment_score"))


@register("d01_persona_overview", with_("personas") + """
SELECT persona_name, market_value, estimated_population, targeting_effectiveness, persona_type FROM personas""",
          ("market_value", "targeting_effectiveness"))
def d01(spark, d):
    return persona_table(spark, d).select("persona_name", "market_value", "estimated_population",
                                          "targeting_effectiveness", "persona_type")


@register("d02_persona_type_counts", with_("personas") + """
SELECT persona_type, count(*) AS personas FROM personas GROUP BY persona_type""")
def d02(spark, d):
    return persona_table(spark, d).groupBy("persona_type").agg(F.count(F.lit(1)).alias("personas"))


@register("d03_seasonal_series", with_("personas") + " UNION ALL ".join(
    f"SELECT persona_name, '{s.title()}' AS season, coalesce({s}, 1.0) AS multiplier FROM personas"
    for s in _SEASONS), ("multiplier",))
def d03(spark, d):
    p = persona_table(spark, d)
    seasons = F.array(*[F.lit(s) for s in _SEASONS])
    ex = p.select("persona_name", "seasonal_trends", F.explode(seasons).alias("s"))
    return ex.select("persona_name", text.title_case(F.col("s")).alias("season"),
                     F.coalesce(F.element_at(F.col("seasonal_trends"), F.col("s")), F.lit(1.0)).alias("multiplier"))


@register("d04_d05_d06_panels", with_("personas") + """
SELECT sum(market_value) AS total_value, max(market_value) AS best_value, avg(market_value) AS mean_value,
       sum(estimated_population) AS total_population, max(estimated_population) AS largest_population,
       avg(estimated_population) AS mean_population, avg(targeting_effectiveness) AS mean_effectiveness,
       count_if(targeting_effectiveness > 0.7) AS high_effectiveness_count,
       max(targeting_effectiveness) AS best_effectiveness FROM personas""",
          ("total_value", "best_value", "mean_value", "mean_population", "mean_effectiveness", "best_effectiveness"))
def d04(spark, d):
    p = persona_table(spark, d)
    return p.agg(F.sum("market_value").alias("total_value"), F.max("market_value").alias("best_value"),
                 F.avg("market_value").alias("mean_value"), F.sum("estimated_population").alias("total_population"),
                 F.max("estimated_population").alias("largest_population"),
                 F.avg("estimated_population").alias("mean_population"),
                 F.avg("targeting_effectiveness").alias("mean_effectiveness"),
                 F.count_if(F.col("targeting_effectiveness") > 0.7).alias("high_effectiveness_count"),
                 F.max("targeting_effectiveness").alias("best_effectiveness"))


@register("d05_population_shares", with_("personas") + """
SELECT persona_name, estimated_population * 1.0 / sum(estimated_population) OVER () AS population_share
FROM personas""", ("population_share",))
def d05(spark, d):
    p = persona_table(spark, d)
    return p.select("persona_name", (F.col("estimated_population") / F.sum("estimated_population")
                                     .over(Window.partitionBy())).alias("population_share"))


@register("d07_opportunity_overview", with_("opportunities") + f"""
SELECT sum(estimated_market_size) AS total_market_size, count(*) AS opportunities,
       avg({_ROI_LO}) AS mean_roi_low FROM opportunities""", ("total_market_size", "mean_roi_low"))
def d07(spark, d):
    o = opportunity_table(spark, d)
    lo, _, _ = text.roi_range(F.col("expected_roi"))
    return o.agg(F.sum("estimated_market_size").alias("total_market_size"),
                 F.count(F.lit(1)).alias("opportunities"), F.avg(lo).alias("mean_roi_low"))


@register("d08_investment_level_counts", with_("opportunities") + """
SELECT investment_level, count(*) AS opportunities FROM opportunities GROUP BY investment_level""")
def d08(spark, d):
    return opportunity_table(spark, d).groupBy("investment_level").agg(F.count(F.lit(1)).alias("opportunities"))


@register("d16_marker_sizing", with_("personas") + """
SELECT persona_id, greatest(10.0, estimated_population / 1000.0) AS marker_size,
       market_value / 10000.0 AS bubble_size,
       2.0 * max(market_value / 10000.0) OVER () / (40.0 * 40.0) AS size_reference FROM personas""",
          ("marker_size", "bubble_size", "size_reference"))
def d16(spark, d):
    p = persona_table(spark, d)
    bubble = F.col("market_value") / 10000.0
    return p.select("persona_id", F.greatest(F.lit(10.0), F.col("estimated_population") / 1000.0).alias("marker_size"),
                    bubble.alias("bubble_size"),
                    (2.0 * F.max(bubble).over(Window.partitionBy()) / (40.0 * 40.0)).alias("size_reference"))


@register("d17_selected_persona_totals", with_("personas") + """
SELECT sum(market_value) AS selected_value, sum(estimated_population) AS selected_population,
       avg(targeting_effectiveness) AS selected_effectiveness FROM personas
WHERE persona_id IN (SELECT persona_id FROM personas WHERE cluster_id % 2 = 0)""",
          ("selected_value", "selected_effectiveness"))
def d17(spark, d):
    """Totals over a selection of personas (B23 persona filter: the
    even-numbered clusters, a semi join against the selection)."""
    p = persona_table(spark, d)
    sel = p.where(F.pmod(F.col("cluster_id"), F.lit(2)) == 0).select("persona_id")
    return p.join(sel, "persona_id", "left_semi").agg(
        F.sum("market_value").alias("selected_value"), F.sum("estimated_population").alias("selected_population"),
        F.avg("targeting_effectiveness").alias("selected_effectiveness"))


@register("d18_persona_spending_bars", with_("personas") + """
SELECT persona_id, 'Restaurants' AS category, spending_pct_restaurants AS share,
       spending_pct_restaurants * 100.0 / greatest(spending_pct_restaurants, spending_pct_retail,
       spending_pct_entertainment) AS bar_width FROM personas
UNION ALL SELECT persona_id, 'Retail', spending_pct_retail, spending_pct_retail * 100.0 / greatest(
       spending_pct_restaurants, spending_pct_retail, spending_pct_entertainment) FROM personas
UNION ALL SELECT persona_id, 'Entertainment', spending_pct_entertainment, spending_pct_entertainment * 100.0
       / greatest(spending_pct_restaurants, spending_pct_retail, spending_pct_entertainment) FROM personas""",
          ("share", "bar_width"))
def d18(spark, d):
    """Category share per persona with the bar width value / row max · 100
    (F14) and title-cased category names (F18)."""
    t = P.cluster_traits(metrics.cluster_profiles(CC.raw_long(spark, d), views.assignments(spark, d), "county_fips"),
                         views.assignments(spark, d))
    cats = ["restaurants", "retail", "entertainment"]
    m = F.create_map(*[x for c in cats for x in (F.lit(c), F.col(f"spending_pct_{c}"))])
    row_max = F.greatest(*[F.col(f"spending_pct_{c}") for c in cats])
    ex = t.select(F.concat(F.lit("persona_"), F.col("cluster").cast("string")).alias("persona_id"),
                  row_max.alias("mx"), F.explode(m).alias("category", "share"))
    return ex.select("persona_id", text.title_case(F.col("category")).alias("category"), "share",
                     pct_of_max(F.col("share"), F.col("mx")).alias("bar_width"))


@register("f14_trend_rescale", with_("personas") + """
SELECT persona_id, CASE WHEN max(summer) OVER () - min(summer) OVER () = 0 THEN 1.0
       ELSE (summer - min(summer) OVER ()) / (max(summer) OVER () - min(summer) OVER ()) END AS summer_scaled
FROM personas""", ("summer_scaled",))
def f14(spark, d):
    p = _flat(persona_table(spark, d))
    w = Window.partitionBy()
    return p.select("persona_id", rescale_unit(F.col("summer"), F.min("summer").over(w),
                                               F.max("summer").over(w)).alias("summer_scaled"))


@register("f16_f17_list_formatting", with_("opportunities") + """
SELECT opportunity_type, target_segments AS segments_joined,
       array_to_string(list_slice(string_split(key_metrics, ', '), 1, 3), ', ') AS first_metrics,
       substring(description, 1, 150) AS description_head FROM opportunities""")
def f16(spark, d):
    o = opportunity_table(spark, d)
    return o.select("opportunity_type", text.list_join(F.col("target_segments")).alias("segments_joined"),
                    text.list_join(text.list_head(F.col("key_metrics"), 3)).alias("first_metrics"),
                    text.text_head(F.col("description"), 150).alias("description_head"))


@register("o07_generate_market_insights")
def o07(spark, d):
    """One nested record: overview, persona distribution, seasonal
    patterns, opportunities, recommendations, risks and key insights."""
    p = persona_table(spark, d)
    o = opportunity_table(spark, d)
    ov = P.market_overview(p)
    dist = P.population_by_type(p).agg(F.map_from_entries(F.collect_list(
        F.struct("persona_type", "population"))).alias("persona_distribution"))
    seas = P.seasonal_patterns(p).agg(F.map_from_entries(F.collect_list(
        F.struct("season", F.struct("avg_multiplier", "variation")))).alias("seasonal_patterns"))
    opps = o.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "rule_order", "opportunity_type", "description", "estimated_market_size", "expected_roi",
        "implementation_timeline"))), lambda s: s.dropFields("rule_order")).alias("business_opportunities"))
    rec = P.recommendations(p).agg(F.collect_list("recommendation").alias("strategic_recommendations"))
    risk = P.risks(p).agg(F.collect_list("risk").alias("risk_assessment"))
    ins = P.key_insights(p).select(F.struct("*").alias("key_insights"))
    return ov.select(
        F.struct("*").alias("market_overview"),
        dist.select("persona_distribution").scalar().alias("persona_distribution"),
        seas.select("seasonal_patterns").scalar().alias("seasonal_patterns"),
        opps.select("business_opportunities").scalar().alias("business_opportunities"),
        rec.select("strategic_recommendations").scalar().alias("strategic_recommendations"),
        risk.select("risk_assessment").scalar().alias("risk_assessment"),
        ins.select("key_insights").scalar().alias("key_insights"))


@register("a12_export_business_intelligence", with_("personas") + """
SELECT persona_id, persona_name, market_value FROM personas""", ("market_value",))
def a12(spark, d):
    """Personas, opportunities and insights written as JSON under the
    session's shared folder, read back (the files are the output)."""
    import uuid

    from tessera.sources import io
    base = io.scratch_path(spark, "bi-" + uuid.uuid4().hex[:8])
    io.export_json(persona_table(spark, d).withColumn("seasonal_trends", F.to_json("seasonal_trends")),
                   base + "/personas")
    io.export_json(opportunity_table(spark, d), base + "/opportunities")
    return spark.read.json(base + "/personas").select("persona_id", "persona_name", "market_value")


def _export_base(spark, name):
    import uuid

    from tessera.sources import io
    return io.scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


@register("a10_export_engineered_features", with_("prepared_long") + """
SELECT feature, 'standard' AS method, 'mean' AS param, avg(value) AS value,
       (SELECT count(*) FROM prepared_long) AS records FROM prepared_long GROUP BY feature
UNION ALL
SELECT feature, 'standard', 'scale', CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END,
       (SELECT count(*) FROM prepared_long) FROM prepared_long GROUP BY feature""", (("value", 4),))
def a10(spark, d):
    """Scaled county features plus the scaler parameters as a table
    (feature, method, param, value), with the metadata sidecar."""
    from tessera.operators import prep
    from tessera.sources import io
    base = _export_base(spark, "features")
    long = prep.prepare_clustering_data(CC.county_features(spark, d), "county_fips", CC.CLUSTER_FEATURES)
    scaled, params = prep.standardize(long)
    meta = io.save_processed_data(scaled, base + "/features.parquet", {"pipeline": "median-impute,standardize"},
                                  distinct_col="county_fips")
    p = params.select("feature", F.lit("standard").alias("method"), F.explode(F.array(
        F.struct(F.lit("mean").alias("param"), F.col("mean").alias("value")),
        F.struct(F.lit("scale").alias("param"), F.col("scale").alias("value")))).alias("pv")).select(
        "feature", "method", "pv.param", "pv.value")
    io.save_data(p, base + "/scaler.parquet")
    return spark.read.parquet(base + "/scaler.parquet").withColumn("records", F.lit(meta["record_count"]))


@register("a11_export_clustering_results", with_("labels") + """
SELECT county_fips, CAST(cluster AS BIGINT) AS fixed_labels_cluster FROM labels""")
def a11(spark, d):
    """Per-algorithm assignments (county_fips, <alg>_cluster) as CSV and
    nested cluster profiles (cluster → feature → stats) as JSON."""
    from tessera.sources import io
    base = _export_base(spark, "clustering")
    labels = views.assignments(spark, d).withColumnRenamed("cluster", "fixed_labels_cluster")
    io.save_data(labels, base + "/fixed_labels_assignments.csv")
    prof = metrics.cluster_profiles(CC.raw_long(spark, d), views.assignments(spark, d), "county_fips")
    nested = prof.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("mean", "median", "std", "min", "max", "count")))).alias("feature_statistics"))
    io.export_json(nested, base + "/profiles")
    back = io.load_saved_data(spark, base + "/fixed_labels_assignments.csv",
                              schema="county_fips string, fixed_labels_cluster int")
    return back.join(spark.read.json(base + "/profiles").select(F.col("cluster").alias("fixed_labels_cluster")),
                     "fixed_labels_cluster", "left_semi")


@register("a13_api_endpoints", with_("personas") + """
SELECT count(*) AS personas, sum(market_value) AS total_market_value FROM personas""", ("total_market_value",))
def a13(spark, d):
    """JSON extracts for personas, opportunities and metadata."""
    from tessera.sources import io
    base = _export_base(spark, "api")
    p = persona_table(spark, d).select("persona_id", "persona_name", "persona_type", "market_value",
                                       "targeting_effectiveness", "estimated_population")
    io.export_json(p, base + "/personas")
    io.export_json(opportunity_table(spark, d).select("opportunity_type", "estimated_market_size", "expected_roi",
                                                      "implementation_timeline"), base + "/opportunities")
    meta = p.agg(F.count(F.lit(1)).alias("personas"), F.sum("market_value").alias("total_market_value"))
    io.export_json(meta, base + "/metadata")
    return spark.read.json(base + "/metadata")
