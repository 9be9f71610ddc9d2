"""Spending aggregation, time-series and spending features
(H03-H05, H09, W01-W04, W06-W08, E05-E08, J01, J04, J09).

The spending table is county × month × category, so every operator here is
a grouped aggregate or a window partitioned by county; no operator
collects a county's rows.  Pivots take the categories that the data hold
(one small distinct, of the size of the schema), so no category's money is
left out, and compile to conditional sums in one partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.functions.bands import quantile_cut
from tessera.functions.stats import grouped_quantiles
from tessera.sources.views import CATEGORY_BY_PART_TYPE

# Fixed values that must equal the reference's results.
ESSENTIAL = ["grocery", "healthcare", "transportation"]
DISCRETIONARY = ["restaurants", "entertainment", "retail"]
ENTROPY_EPS = 1e-10
# Categories of the adapter's spending table, in pivot (sorted) order: what its oracles spell out.
CATEGORIES = sorted(CATEGORY_BY_PART_TYPE.values())

AGG_FUNCS = {
    "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "count": F.count,
    "min": F.min, "max": F.max, "var": F.var_samp,
}


def category_list(spending: DataFrame) -> list[str]:
    """The categories that occur, sorted."""
    return sorted(r[0] for r in spending.select("category").distinct().collect() if r[0] is not None)


def _with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c.removeprefix(prefix) for c in df.columns if c.startswith(prefix)]


def aggregate_spending(df: DataFrame, group_cols: Sequence[str],
                       agg_functions: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Free grouping; columns named ``<col>_<fn>`` (whitelisted fns)."""
    agg_functions = agg_functions or {"spending_amount": ["sum", "mean", "std", "count"]}
    exprs, medians, order = [], [], list(group_cols)
    for c, fns in agg_functions.items():
        for fn in ([fns] if isinstance(fns, str) else fns):
            order.append(f"{c}_{fn}")
            if fn == "median":
                medians.append(grouped_quantiles(df, list(group_cols), c, {f"{c}_median": 0.5}))
            elif fn in AGG_FUNCS:
                exprs.append(AGG_FUNCS[fn](F.col(c)).alias(f"{c}_{fn}"))
            else:
                raise ValueError(f"unsupported aggregate {fn!r}")
    out = df.groupBy(*group_cols).agg(*(exprs or [F.count(F.lit(1)).alias("_rows")]))
    for m in medians:
        out = out.join(m, list(group_cols), "left")
    return out.select(*order)


def pivot_spending(spending: DataFrame, categories: Sequence[str] | None = None,
                   fill_zero: bool = True) -> DataFrame:
    """H05 (fill 0) / H03 pivot (missing stays null): spending_<cat> sums of the categories that occur."""
    categories = category_list(spending) if categories is None else categories
    p = (spending.groupBy("county_fips").pivot("category", list(categories))
         .agg(F.sum("spending_amount")))
    for c in categories:
        p = p.withColumnRenamed(c, f"spending_{c}")
    if fill_zero:
        p = p.na.fill(0.0, [f"spending_{c}" for c in categories])
    return p


def join_mobility_spending(mobility: DataFrame, spending: DataFrame,
                           categories: Sequence[str] | None = None) -> DataFrame:
    """H03 + J01: pivot of per-category sums, inner joined on county.

    The reference pivots only when month and year exist; otherwise the
    spending table is joined as given."""
    if "month" in spending.columns and "year" in spending.columns:
        spending = pivot_spending(spending, categories, fill_zero=False)
    return mobility.join(spending, "county_fips", "inner")


def spending_by_period(spending: DataFrame) -> DataFrame:
    """Total by county, year, month."""
    return spending.groupBy("county_fips", "year", "month").agg(
        F.sum("spending_amount").alias("spending_amount"))


def add_lag_features(period: DataFrame) -> DataFrame:
    """W07 + W01 + W02 over H09 output, per county ordered by date."""
    p = temporal.calendar_keys(period)
    w = Window.partitionBy("county_fips").orderBy("date")
    roll = w.rowsBetween(-2, 0)
    return (p.withColumn("spending_lag_1", F.lag("spending_amount", 1).over(w))
            .withColumn("spending_lag_3", F.lag("spending_amount", 3).over(w))
            .withColumn("spending_ma_3", F.when(F.count("spending_amount").over(roll) == 3,
                                                F.avg("spending_amount").over(roll))))


def spending_trend(spending: DataFrame) -> DataFrame:
    """OLS slope of period totals on 0..n-1, only with > 2 periods."""
    per = spending_by_period(spending)
    w = Window.partitionBy("county_fips").orderBy("year", "month")
    per = per.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    return (per.groupBy("county_fips")
            .agg(F.count(F.lit(1)).alias("n"), F.regr_slope("spending_amount", "x").alias("spending_trend"))
            .where(F.col("n") > 2).select("county_fips", "spending_trend"))


def spending_volatility(spending: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """std/mean per county × category when n > 1 and mean > 0,
    pivoted to spending_volatility_<cat>."""
    categories = category_list(spending) if categories is None else categories
    g = spending.groupBy("county_fips", "category").agg(
        F.count("spending_amount").alias("n"), F.avg("spending_amount").alias("m"),
        F.stddev_samp("spending_amount").alias("s"))
    g = g.withColumn("cv", F.when((F.col("n") > 1) & (F.col("m") > 0), F.try_divide(F.col("s"), F.col("m"))))
    p = g.groupBy("county_fips").pivot("category", list(categories)).agg(F.first("cv"))
    for c in categories:
        p = p.withColumnRenamed(c, f"spending_volatility_{c}")
    return p


def spending_temporal_features(features: DataFrame, spending: DataFrame,
                               categories: Sequence[str] | None = None) -> DataFrame:
    """W04 + W03 for counties with ≥ 2 spending rows, left joined."""
    eligible = (spending.groupBy("county_fips").agg(F.count(F.lit(1)).alias("rows"))
                .where(F.col("rows") >= 2).select("county_fips"))
    s = spending.join(eligible, "county_fips", "left_semi")
    vol = spending_volatility(s, categories)
    trend = spending_trend(s)
    t = vol.join(trend, "county_fips", "full")
    return features.join(t, "county_fips", "left")


def share(x: Column, total: Column) -> Column:
    """X / total, 0 when the total is 0 or missing."""
    return F.coalesce(F.try_divide(x, total), F.lit(0.0))


def add_spending_proportions(pivot: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Total, shares spending_pct_<cat>, entropy diversity."""
    categories = _with_prefix(pivot, "spending_") if categories is None else list(categories)
    total = sum((F.col(f"spending_{c}") for c in categories[1:]), F.col(f"spending_{categories[0]}"))
    df = pivot.withColumn("total_spending", total)
    for c in categories:
        df = df.withColumn(f"spending_pct_{c}", share(F.col(f"spending_{c}"), F.col("total_spending")))
    ent = None
    for c in categories:
        p = F.col(f"spending_pct_{c}") + F.lit(ENTROPY_EPS)
        term = p * F.log(p)
        ent = term if ent is None else ent + term
    return df.withColumn("spending_diversity", -ent)


def add_spending_intensity(df: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """F05 intensity band, F08 dominant category/share, F09 totals."""
    categories = _with_prefix(df, "spending_pct_") if categories is None else list(categories)
    df = quantile_cut(df, "total_spending", (0.25, 0.75), out="spending_intensity_category")
    pct = [f"spending_pct_{c}" for c in categories]
    mx = F.greatest(*[F.col(c) for c in pct])
    dom = None
    for c in pct:  # first column reaching the max, in column order
        dom = F.when(F.col(c) == mx, F.lit(c)) if dom is None else dom.when(F.col(c) == mx, F.lit(c))
    df = df.withColumn("dominant_spending_category", dom).withColumn("dominant_spending_share", mx)
    ess = [c for c in ESSENTIAL if c in categories]
    dis = [c for c in DISCRETIONARY if c in categories]
    if ess:
        df = df.withColumn("essential_spending", sum((F.col(f"spending_{c}") for c in ess[1:]),
                                                     F.col(f"spending_{ess[0]}")))
    if dis:
        df = df.withColumn("discretionary_spending", sum((F.col(f"spending_{c}") for c in dis[1:]),
                                                         F.col(f"spending_{dis[0]}")))
    if ess and dis:
        df = df.withColumn("discretionary_ratio", share(
            F.col("discretionary_spending"), F.col("essential_spending") + F.col("discretionary_spending")))
    return df


def latest_population(population: DataFrame) -> DataFrame:
    """Population at the global latest year (scalar subquery)."""
    latest = population.select(F.max("year")).scalar()
    return population.where(F.col("year") == latest).select("county_fips", "population")


def add_per_capita_spending(df: DataFrame, population: DataFrame,
                            categories: Sequence[str] | None = None) -> DataFrame:
    """Category amounts and total divided by latest population."""
    categories = _with_prefix(df, "spending_pct_") if categories is None else list(categories)
    out = df.join(latest_population(population), "county_fips", "left")
    for c in categories:
        out = out.withColumn(f"spending_per_capita_{c}",
                             F.try_divide(F.col(f"spending_{c}"), F.col("population").cast("double")))
    return out.withColumn("total_spending_per_capita",
                          F.try_divide(F.col("total_spending"), F.col("population").cast("double")))


def create_spending_features(spending: DataFrame, population: DataFrame | None,
                             categories: Sequence[str] | None = None) -> DataFrame:
    """H05 → E05 → E06 → W08 → E07."""
    categories = category_list(spending) if categories is None else list(categories)
    f = pivot_spending(spending, categories)
    f = add_spending_proportions(f, categories)
    f = add_spending_intensity(f, categories)
    f = spending_temporal_features(f, spending, categories)
    if population is not None:
        f = add_per_capita_spending(f, population, categories)
    return f
