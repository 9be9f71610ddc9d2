"""Rule-based personas, opportunities and market insights.

Input is the K09 profile in long form (cluster, feature, mean, ...) plus
the label table; every rule is a ``when`` chain over one row per cluster,
so the whole chain is a handful of small aggregates and projections.
Rule tables (persona types, opportunities) are small literal dimensions
joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bands import clip

# Fixed values that must equal the reference's results.
PERSONA_TYPES = ["Urban Commuter", "Leisure Cyclist", "Tourist Explorer", "Fitness Enthusiast",
                 "Budget Conscious", "Premium Consumer", "Family Oriented", "Tech Savvy"]
BASE_NAMES = {
    "Urban Commuter": ["Daily Commuter", "City Navigator", "Rush Hour Rider"],
    "Leisure Cyclist": ["Weekend Warrior", "Casual Explorer", "Recreational Rider"],
    "Tourist Explorer": ["City Tourist", "Visitor Explorer", "Sightseeing Cyclist"],
    "Fitness Enthusiast": ["Fitness Rider", "Active Cyclist", "Health-Focused User"],
    "Premium Consumer": ["Premium Spender", "Affluent User", "High-Value Customer"],
    "Budget Conscious": ["Value Seeker", "Budget-Minded User", "Cost-Conscious Rider"],
    "Family Oriented": ["Family User", "Community Rider", "Neighborhood Cyclist"],
    "Tech Savvy": ["Digital Native", "Tech-Forward User", "Connected Cyclist"],
}
DESCRIPTIONS = {
    "Urban Commuter": (
        "Highly structured individuals who rely on bike-sharing for daily commuting. "
        "They exhibit strong peak-hour usage patterns and maintain consistent membership. "
        "These users value reliability, convenience, and time efficiency in their transportation choices."),
    "Leisure Cyclist": (
        "Recreation-focused users who primarily bike during weekends and leisure time. "
        "They enjoy exploring the city at a relaxed pace and often combine cycling with social activities. "
        "These users value flexibility and scenic routes over speed and efficiency."),
    "Tourist Explorer": (
        "Visitors and occasional users who use bike-sharing to explore the city. "
        "They typically take shorter trips to tourist destinations and entertainment venues. "
        "These users prioritize convenience, ease of use, and access to popular attractions."),
    "Fitness Enthusiast": (
        "Health-conscious individuals who use cycling as part of their fitness routine. "
        "They tend to take longer trips and are active during both weekdays and weekends. "
        "These users value performance tracking, route variety, and health benefits."),
    "Premium Consumer": (
        "High-spending individuals with significant discretionary income. "
        "They are willing to pay for premium services and convenience features. "
        "These users value quality, exclusivity, and personalized experiences."),
    "Budget Conscious": (
        "Cost-sensitive users who prioritize value and affordability. "
        "They carefully consider spending decisions and look for deals and promotions. "
        "These users value transparent pricing, cost-effectiveness, and basic reliability."),
    "Family Oriented": (
        "Community-focused individuals who often bike with family members or in groups. "
        "They prioritize safety, family-friendly routes, and community amenities. "
        "These users value safety features, group options, and neighborhood connectivity."),
    "Tech Savvy": (
        "Technology-forward users who embrace digital solutions and smart features. "
        "They actively use mobile apps, digital payments, and data tracking features. "
        "These users value innovation, connectivity, and seamless digital experiences."),
}
DEFAULT_DESCRIPTION = "General bike-sharing user with varied usage patterns."
VALUE_PER_USER = {"high": 500.0, "medium": 200.0, "low": 100.0}
MEMBERSHIP_MULTIPLIER = {"high": 1.5, "medium": 1.2, "low": 0.8}
SEASON_BASE = {"spring": 1.0, "summer": 1.2, "fall": 0.9, "winter": 0.7}
DEMOGRAPHIC_DEFAULTS = {"median_income": 65000.0, "age_18_34": 0.3, "age_35_54": 0.4, "age_55_plus": 0.3,
                        "bachelor_plus": 0.4, "high_school": 0.6}
OPPORTUNITY_RULES = [
    # (opportunity_type, persona type or None for the value rule, description, investment, roi, timeline, metrics)
    ("Market Expansion", None, "Focus on high-value customer segments for premium service offerings",
     "Medium", "15-25%", "6-12 months", ["Customer lifetime value", "Premium conversion rate", "Revenue per user"]),
    ("Technology Integration", "Tech Savvy", "Develop advanced digital features and IoT integrations",
     "High", "20-35%", "12-18 months", ["App engagement", "Feature adoption", "Digital conversion"]),
    ("Infrastructure Investment", "Urban Commuter", "Expand station network in high-commuter areas",
     "High", "10-20%", "18-24 months", ["Station utilization", "Commuter retention", "Peak hour capacity"]),
    ("Tourism Partnerships", "Tourist Explorer", "Develop partnerships with hotels and attractions",
     "Low", "25-40%", "3-6 months", ["Tourist conversion", "Partnership revenue", "Seasonal growth"]),
]
RECOMMENDATIONS = [
    "Focus on premium service offerings to capture high-value segments",
    "Implement dynamic pricing and capacity management for seasonal demand",
    "Invest in digital innovation and smart technology features",
    "Consider geographic expansion to similar markets",
]
RISKS = [
    "High concentration in single customer segment",
    "High seasonal dependency with winter vulnerability",
    "Technology disruption risk from changing user expectations",
    "Economic downturn sensitivity due to price-conscious segments",
]
TRAIT_FEATURES = ["total_trips", "avg_trip_duration_minutes", "member_ratio", "weekend_ratio", "peak_hour_ratio",
                  "total_spending", "spending_pct_restaurants", "spending_pct_retail", "spending_pct_entertainment",
                  "discretionary_ratio", "night_trips_ratio", "seasonal_variation"]
# Defaults used by the reference when a feature is absent from a profile.
TRAIT_DEFAULTS = {"total_trips": 0.0, "avg_trip_duration_minutes": 0.0, "member_ratio": 0.0, "weekend_ratio": 0.3,
                  "peak_hour_ratio": 0.3, "total_spending": 0.0, "spending_pct_restaurants": 0.0,
                  "spending_pct_retail": 0.0, "spending_pct_entertainment": 0.0, "discretionary_ratio": 0.5,
                  "night_trips_ratio": 0.1, "seasonal_variation": 0.2}


def _band3(x: Column, hi: float, mid: float, labels=("high", "medium", "low")) -> Column:
    return F.when(x > hi, labels[0]).when(x > mid, labels[1]).otherwise(labels[2])


def profile_means(profiles: DataFrame) -> DataFrame:
    """Pivot K09 means to one row per cluster; absent features → defaults."""
    present = [r[0] for r in profiles.select("feature").distinct().collect()]
    feats = [f for f in TRAIT_FEATURES if f in present]
    wide = profiles.groupBy("cluster").pivot("feature", feats).agg(F.first("mean"))
    for f in TRAIT_FEATURES:
        if f not in feats:
            wide = wide.withColumn(f, F.lit(TRAIT_DEFAULTS[f]))
    return wide


def cluster_traits(profiles: DataFrame, labels: DataFrame, id_col: str = "county_fips") -> DataFrame:
    """Mobility, spending and temporal trait bands and the persona
    type for every cluster except noise."""
    m = profile_means(profiles).where(F.col("cluster") != -1)
    sizes = labels.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.array_sort(F.collect_list(F.col(id_col).cast("string"))).alias("members"))
    t = m.join(sizes, "cluster")
    t = t.select(
        "*",
        _band3(F.col("total_trips"), 8000, 3000).alias("usage_intensity"),
        _band3(F.col("avg_trip_duration_minutes"), 20, 12, ("long", "medium", "short")).alias("trip_length_preference"),
        _band3(F.col("member_ratio"), 0.7, 0.4).alias("membership_commitment"),
        _band3(F.col("weekend_ratio"), 0.4, 0.25).alias("weekend_usage"),
        _band3(F.col("peak_hour_ratio"), 0.35, 0.25, ("strong", "moderate", "weak")).alias("commuter_pattern"),
        _band3(F.col("total_spending"), 800000, 400000).alias("spending_level"),
        _band3(F.col("spending_pct_restaurants"), 0.25, 0.15).alias("dining_preference"),
        _band3(F.col("spending_pct_retail"), 0.3, 0.2).alias("retail_orientation"),
        _band3(F.col("spending_pct_entertainment"), 0.15, 0.08).alias("entertainment_focus"),
        _band3(F.col("discretionary_ratio"), 0.6, 0.4).alias("discretionary_spending"),
        F.when(F.col("peak_hour_ratio") > 0.35, "structured").otherwise("flexible").alias("schedule_type"),
        _band3(F.col("weekend_ratio"), 0.35, 0.25, ("active", "moderate", "inactive")).alias("weekend_activity"),
        _band3(F.col("night_trips_ratio"), 0.15, 0.05, ("frequent", "occasional", "rare")).alias("night_usage"),
        _band3(F.col("seasonal_variation"), 0.3, 0.15).alias("seasonal_sensitivity"),
    )
    c = F.col
    ptype = (F.when((c("commuter_pattern") == "strong") & (c("membership_commitment") == "high")
                    & (c("schedule_type") == "structured"), "Urban Commuter")
             .when((c("weekend_activity") == "active") & (c("schedule_type") == "flexible")
                   & c("usage_intensity").isin("medium", "high"), "Leisure Cyclist")
             .when((c("membership_commitment") == "low") & (c("trip_length_preference") == "short")
                   & (c("entertainment_focus") == "high"), "Tourist Explorer")
             .when((c("trip_length_preference") == "long") & (c("weekend_activity") == "active")
                   & (c("usage_intensity") == "high"), "Fitness Enthusiast")
             .when((c("spending_level") == "high") & (c("discretionary_spending") == "high"), "Premium Consumer")
             .when((c("spending_level") == "low") & (c("discretionary_spending") == "low"), "Budget Conscious")
             .when((c("membership_commitment") == "high") & (c("retail_orientation") == "high"), "Tech Savvy")
             .otherwise("Family Oriented"))
    return t.withColumn("persona_type", ptype)


def _lookup_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def persona_name(ptype: Column, intensity: Column, cluster_id: Column) -> Column:
    """Power / Regular / Casual + a base name of the type, chosen
    deterministically by cluster id (the reference draws it at random)."""
    names = F.create_map(*[x for k, v in BASE_NAMES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    base = F.coalesce(F.element_at(F.element_at(names, ptype), (F.pmod(cluster_id, F.lit(3)) + 1).cast("int")),
                      F.lit("Generic User"))
    mod = F.when(intensity == "high", "Power").when(intensity == "low", "Casual").otherwise("Regular")
    return F.concat_ws(" ", mod, base)


def market_value(size: Column, spending_level: Column, membership: Column) -> Column:
    """Size × value per user × membership multiplier, rounded to 2."""
    vpu = F.coalesce(F.element_at(_lookup_map(VALUE_PER_USER), spending_level), F.lit(100.0))
    mult = F.coalesce(F.element_at(_lookup_map(MEMBERSHIP_MULTIPLIER), membership), F.lit(1.0))
    return F.round(size.cast("double") * vpu * mult, 2)


def targeting_effectiveness(top_features: DataFrame) -> DataFrame:
    """min(mean |z| of the top distinguishing features / 2, 1), 3 decimals."""
    return top_features.groupBy("cluster").agg(
        F.round(F.least(F.avg(F.abs("z_score")) / 2.0, F.lit(1.0)), 3).alias("targeting_effectiveness"))


def seasonal_trends(s: Column) -> Column:
    """Base multipliers, + s for spring and summer, - s/2 for fall and
    winter, clipped to [0.3, 1.8]; returned as a map season → multiplier."""
    entries = []
    for season, base in SEASON_BASE.items():
        v = F.lit(base) + s if season in ("spring", "summer") else F.lit(base) - s * 0.5
        entries += [F.lit(season), clip(v, 0.3, 1.8)]
    return F.create_map(*entries)


def demographic_profile(traits: DataFrame, demographics: DataFrame) -> DataFrame:
    """Mean demographics of each cluster's member counties, fixed
    defaults when no member has demographics."""
    ex = traits.select("cluster", F.explode("members").alias("county_fips"))
    j = ex.join(demographics, "county_fips", "left")
    d = DEMOGRAPHIC_DEFAULTS
    return j.groupBy("cluster").agg(
        F.coalesce(F.avg("median_income"), F.lit(d["median_income"])).alias("median_income"),
        F.coalesce(F.avg("age_18_34_pct"), F.lit(d["age_18_34"])).alias("age_18_34"),
        F.coalesce(F.avg("age_35_54_pct"), F.lit(d["age_35_54"])).alias("age_35_54"),
        F.coalesce(F.avg("age_55_plus_pct"), F.lit(d["age_55_plus"])).alias("age_55_plus"),
        F.coalesce(F.avg("bachelor_plus_pct"), F.lit(d["bachelor_plus"])).alias("bachelor_plus"),
        F.coalesce(F.avg("high_school_pct"), F.lit(d["high_school"])).alias("high_school"))


def generate_personas(profiles: DataFrame, top_features: DataFrame, labels: DataFrame,
                      demographics: DataFrame | None = None, id_col: str = "county_fips") -> DataFrame:
    """One persona per non-noise cluster (N05-N11 combined)."""
    t = cluster_traits(profiles, labels, id_col)
    eff = targeting_effectiveness(top_features)
    p = (t.join(eff, "cluster", "left")
         .withColumn("targeting_effectiveness", F.coalesce(F.col("targeting_effectiveness"), F.lit(0.5)))
         .select(
             F.concat(F.lit("persona_"), F.col("cluster").cast("string")).alias("persona_id"),
             F.col("cluster").alias("cluster_id"), "persona_type",
             persona_name(F.col("persona_type"), F.col("usage_intensity"), F.col("cluster")).alias("persona_name"),
             F.col("size").alias("estimated_population"), "members",
             market_value(F.col("size"), F.col("spending_level"), F.col("membership_commitment"))
             .alias("market_value"),
             "targeting_effectiveness",
             seasonal_trends(F.col("seasonal_variation")).alias("seasonal_trends"),
             F.coalesce(F.element_at(_lookup_map(DESCRIPTIONS), F.col("persona_type")),
                        F.lit(DEFAULT_DESCRIPTION)).alias("description"),
             "usage_intensity", "trip_length_preference", "membership_commitment", "weekend_usage",
             "commuter_pattern", "spending_level", "dining_preference", "retail_orientation",
             "entertainment_focus", "discretionary_spending", "schedule_type", "weekend_activity",
             "night_usage", "seasonal_sensitivity"))
    if demographics is not None:
        p = p.join(demographic_profile(t, demographics).withColumnRenamed("cluster", "cluster_id"), "cluster_id", "left")
    return p


def _rules_df(spark) -> DataFrame:
    rows = [(t, pt, desc, inv, roi, tl, metrics, i) for i, (t, pt, desc, inv, roi, tl, metrics)
            in enumerate(OPPORTUNITY_RULES)]
    return spark.createDataFrame(rows, "opportunity_type string, persona_type string, description string, "
                                       "investment_level string, expected_roi string, "
                                       "implementation_timeline string, key_metrics array<string>, rule_order int")


def opportunities(personas: DataFrame) -> DataFrame:
    """O01 + O02: one row per firing rule with its target personas (in
    cluster order) and their summed market value; no row when empty."""
    mean_value = personas.select(F.avg("market_value")).scalar()
    rules = _rules_df(personas.sparkSession)
    value_rule = (personas.where(F.col("market_value") > mean_value)
                  .withColumn("opportunity_type", F.lit("Market Expansion")))
    type_rules = personas.join(F.broadcast(rules.where(F.col("persona_type").isNotNull())
                                           .select("persona_type", "opportunity_type")), "persona_type")
    hits = value_rule.select("opportunity_type", "cluster_id", "persona_name", "market_value").unionByName(
        type_rules.select("opportunity_type", "cluster_id", "persona_name", "market_value"))
    agg = hits.groupBy("opportunity_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "persona_name"))),
                    lambda s: s["persona_name"]).alias("target_segments"),
        F.round(F.sum("market_value"), 2).alias("estimated_market_size"))
    return (agg.join(F.broadcast(rules.drop("persona_type")), "opportunity_type")
            .select("opportunity_type", "description", "target_segments", "estimated_market_size",
                    "investment_level", "expected_roi", "implementation_timeline", "key_metrics", "rule_order"))


def market_overview(personas: DataFrame) -> DataFrame:
    """O03."""
    return personas.agg(F.sum("market_value").alias("total_addressable_market"),
                        F.sum("estimated_population").alias("total_population"),
                        F.avg("targeting_effectiveness").alias("average_targeting_effectiveness"),
                        F.count(F.lit(1)).alias("number_of_segments"))


def population_by_type(personas: DataFrame) -> DataFrame:
    """H07."""
    return personas.groupBy("persona_type").agg(F.sum("estimated_population").alias("population"))


def seasonal_patterns(personas: DataFrame) -> DataFrame:
    """Per season mean and population std of the multipliers."""
    ex = personas.select(F.explode("seasonal_trends").alias("season", "multiplier"))
    return ex.groupBy("season").agg(F.avg("multiplier").alias("avg_multiplier"),
                                    F.stddev_pop("multiplier").alias("variation"))


def _flag_list(texts: list[str], conds: list[Column]) -> Column:
    arr = F.array(*[F.when(c, F.lit(t)) for t, c in zip(texts, conds)])
    return F.filter(arr, lambda x: x.isNotNull())


def recommendations(personas: DataFrame) -> DataFrame:
    """The four strategic recommendation rules, in order."""
    s = personas.agg(
        (F.count_if(F.col("market_value") > 100000) / F.count(F.lit(1))).alias("hv_share"),
        F.avg(F.col("seasonal_trends")["summer"] - F.col("seasonal_trends")["winter"]).alias("sw"),
        F.count_if(F.col("persona_type") == "Tech Savvy").alias("tech"),
        F.sum("market_value").alias("total"))
    return s.select(F.explode(_flag_list(RECOMMENDATIONS, [
        F.col("hv_share") > 0.4, F.col("sw") > 0.3, F.col("tech") > 0, F.col("total") > 500000]))
        .alias("recommendation"))


def risks(personas: DataFrame) -> DataFrame:
    """The four market-risk rules, in order."""
    tot = F.sum("estimated_population")
    s = personas.agg(
        (F.max("estimated_population") / tot).alias("max_share"),
        F.avg(F.col("seasonal_trends")["winter"]).alias("winter"),
        (F.count_if(F.col("persona_type") == "Tech Savvy") / F.count(F.lit(1))).alias("tech_share"),
        (F.sum(F.when(F.col("persona_type") == "Budget Conscious", F.col("estimated_population")).otherwise(0))
         / tot).alias("budget_share"))
    return s.select(F.explode(_flag_list(RISKS, [
        F.col("max_share") > 0.5, F.col("winter") < 0.6, F.col("tech_share") > 0.3, F.col("budget_share") > 0.3]))
        .alias("risk"))


def key_insights(personas: DataFrame) -> DataFrame:
    """Highest value, best targeting, best summer persona
    and the commuter total (first persona in cluster order on ties)."""
    return personas.agg(
        F.max_by("persona_name", F.struct("market_value", -F.col("cluster_id"))).alias("highest_value_persona"),
        F.max("market_value").alias("highest_market_value"),
        F.max_by("persona_name", F.struct("targeting_effectiveness", -F.col("cluster_id")))
        .alias("best_targeting_persona"),
        F.max("targeting_effectiveness").alias("best_targeting_effectiveness"),
        F.max_by("persona_name", F.struct(F.col("seasonal_trends")["summer"], -F.col("cluster_id")))
        .alias("best_summer_persona"),
        F.sum(F.when(F.col("persona_type") == "Urban Commuter", F.col("market_value"))).alias("commuter_market_value"))
