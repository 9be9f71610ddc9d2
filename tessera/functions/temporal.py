"""Calendar and time-of-day expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import col

# Fixed values that must equal the reference's results.
SEASON_BY_MONTH = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
}  # every other month: "Fall"
TIME_PERIODS = [(5, 12, "Morning"), (12, 17, "Afternoon"), (17, 21, "Evening")]  # else "Night"


def season(month) -> Column:
    """Winter / Spring / Summer / Fall from a month number."""
    m = col(month)
    expr = None
    for name, months in SEASON_BY_MONTH.items():
        cond = m.isin(*months)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("Fall")


def time_period(hour) -> Column:
    """Morning 5-11, Afternoon 12-16, Evening 17-20, else Night."""
    h = col(hour)
    expr = None
    for lo, hi, name in TIME_PERIODS:
        cond = (h >= lo) & (h < hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("Night")


def add_temporal_features(df: DataFrame, ts_col: str) -> DataFrame:
    """hour, day_of_week (Mon=0), month, year, day_of_year, ISO week,
    is_weekend, season, time_period."""
    ts = F.col(ts_col)
    return (df.withColumn("hour", F.hour(ts))
            .withColumn("day_of_week", F.weekday(ts))
            .withColumn("month", F.month(ts))
            .withColumn("year", F.year(ts))
            .withColumn("day_of_year", F.dayofyear(ts))
            .withColumn("week_of_year", F.weekofyear(ts))
            .withColumn("is_weekend", F.weekday(ts).isin(5, 6))
            .withColumn("season", season(F.month(ts)))
            .withColumn("time_period", time_period(F.hour(ts))))


def time_window(ts, size: str) -> Column:
    """Floor a timestamp to a fixed window (e.g. '1 hour', '15 minutes')."""
    return F.window(col(ts), size).start


def calendar_keys(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """First-of-month date (timestamp, as the reference's pandas
    datetime), quarter, season."""
    d = F.make_timestamp_ntz(F.col(year), F.col(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return (df.withColumn("date", d)
            .withColumn("quarter", F.quarter(d))
            .withColumn("season", season(F.col(month))))
