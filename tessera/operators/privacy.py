"""Privacy and bias checks.

Group sizes come from one grouped count joined back by key (a bounded
table of counties), never from a window partitioned by county, so a
county holding a third of all rows does not land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bands import equal_width_cut

# Fixed values that must equal the reference's results.
DIRECT_ID_PATTERNS = ["name", "email", "phone", "ssn", "id"]
QUASI_ID_PATTERNS = ["zip", "birth", "age", "income"]
BANDS = ["Low", "Medium", "High"]


# What a column's text looks like if it holds identifiers, whatever its name.
VALUE_PATTERNS = {"email_like": r"[^@ ]+@[^@ ]+\.[a-z]+", "number_like": r"^[0-9][0-9-]{4,}$"}


def name_flags(column: str) -> tuple[bool, bool]:
    """direct and quasi identifiers by substring of the lower-case column name."""
    low = column.lower()
    return any(p in low for p in DIRECT_ID_PATTERNS), any(p in low for p in QUASI_ID_PATTERNS)


def identifier_scan(tables: dict[str, DataFrame]) -> DataFrame:
    """Per column the flags of its name, and how many of its values there are and look like identifiers (one
    aggregate per table)."""
    out = None
    for name, df in tables.items():
        rows = []
        for c in df.columns:
            text = F.col(c).cast("string")
            direct, quasi = name_flags(c)
            rows.append(F.struct(
                F.lit(name).alias("dataset"), F.lit(c).alias("column_name"), F.lit(direct).alias("direct_identifier"),
                F.lit(quasi).alias("quasi_identifier"), F.count(F.col(c)).alias("n_values"),
                *[F.count_if(F.coalesce(text.rlike(p), F.lit(False))).alias(n) for n, p in VALUE_PATTERNS.items()]))
        found = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
        out = found if out is None else out.unionByName(found)
    return out


def k_anonymity(df: DataFrame, keys: Sequence[str] = ("county_fips",), k_min: int = 5) -> DataFrame:
    """Smallest group size over the quasi-identifier keys."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("k_anonymity_level"), F.count(F.lit(1)).alias("groups")).withColumn(
        "needs_aggregation", F.col("k_anonymity_level") < k_min)


def demographic_parity(df: DataFrame, labels: DataFrame, attr: str, id_col: str = "county_fips") -> DataFrame:
    """Equal-width bands of ``attr``; share of each cluster
    within each observed band (columns sum to 1, absent cells 0); per
    cluster sample std over bands; mean over clusters; > 0.3 flagged."""
    banded = equal_width_cut(df.select(id_col, attr), attr, out="band").join(labels, id_col)
    counts = banded.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("n"))
    shares = _shares(banded, counts)
    per = shares.groupBy("cluster").agg(F.stddev_samp("share").alias("std"))
    return per.agg(F.avg("std").alias("bias_score")).select(
        F.lit(attr).alias("attribute"), "bias_score", (F.col("bias_score") > 0.3).alias("flagged"))


def parity_shares(df: DataFrame, labels: DataFrame, attr: str, id_col: str = "county_fips") -> DataFrame:
    """The normalized cross table itself (cluster, band, share)."""
    banded = equal_width_cut(df.select(id_col, attr), attr, out="band").join(labels, id_col)
    counts = banded.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("n"))
    return _shares(banded, counts).select("cluster", "band", "share")


def _shares(banded: DataFrame, counts: DataFrame) -> DataFrame:
    """Complete cluster × observed-band grid with 0 for absent cells: each
    cluster is expanded over the three band labels, and the inner equi-join
    with the band totals keeps only observed bands."""
    grid = banded.select("cluster").distinct().select(
        "cluster", F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("band"))
    tot = counts.groupBy("band").agg(F.sum("n").alias("band_n"))
    return (grid.join(F.broadcast(tot), "band").join(counts, ["cluster", "band"], "left")
            .withColumn("share", F.coalesce(F.col("n"), F.lit(0)) / F.col("band_n")))


def cluster_balance(labels: DataFrame) -> DataFrame:
    """Std (n-1) / mean of cluster sizes; > 1 flagged."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.stddev_samp("n") / F.avg("n")).alias("size_coefficient_variation")).withColumn(
        "flagged", F.coalesce(F.col("size_coefficient_variation") > 1.0, F.lit(False)))


def geographic_privacy(df: DataFrame, min_rows: int = 1000, key: str = "county_fips") -> DataFrame:
    """Counties with fewer than ``min_rows`` rows become 'OTHER'.
    Sizes come from a grouped count (bounded by counties) joined back."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    small = sizes.where(F.col("_n") < min_rows).select(key, F.lit(True).alias("_small"))
    return (df.join(small, key, "left")
            .withColumn(key, F.when(F.col("_small"), F.lit("OTHER")).otherwise(F.col(key))).drop("_small"))
