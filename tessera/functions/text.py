"""String parsing and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stats import col

# Fixed values that must equal the reference's results.
INVESTMENT_SCORE = {"Low": 1, "Medium": 2, "High": 3}  # anything else: 2


def roi_range(roi) -> tuple[Column, Column, Column]:
    """"15-25%" → (15, 25, 20); a single value gives it three times."""
    s = F.regexp_replace(col(roi), "%", "")
    parts = F.split(s, "-")
    lo = F.try_element_at(parts, F.lit(1)).try_cast("double")
    hi_raw = F.try_element_at(parts, F.lit(2)).try_cast("double")
    hi = F.when(F.size(parts) >= 2, hi_raw).otherwise(lo)
    return lo, hi, (lo + hi) / 2.0


def timeline_months(timeline) -> Column:
    """leading integer of "6-12 months"; no "month" in the text → 12."""
    t = col(timeline)
    lead = F.regexp_extract(t, r"^\s*(\d+)", 1)
    return (F.when(~F.lower(t).contains("month"), F.lit(12))
            .otherwise(F.when(lead != "", lead.cast("int")).otherwise(F.lit(12))))


def investment_score(level) -> Column:
    """Low 1, Medium 2, High 3, anything else 2."""
    lv = col(level)
    expr = None
    for k, v in INVESTMENT_SCORE.items():
        expr = F.when(lv == k, v) if expr is None else expr.when(lv == k, v)
    return expr.otherwise(2)


def list_join(arr, sep: str = ", ") -> Column:
    """F16."""
    return F.array_join(col(arr), sep)


def list_head(arr, n: int = 3) -> Column:
    """first n items."""
    return F.slice(col(arr), 1, n)


def text_head(s, n: int = 150) -> Column:
    """first n characters."""
    return F.substring(col(s), 1, n)


def title_case(s) -> Column:
    """F18."""
    return F.initcap(col(s))
