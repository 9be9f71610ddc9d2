"""Data-quality checks.

Every dataset's rules are evaluated in **one** aggregate pass (a list of
``count_if`` expressions) and unpivoted to rows
``(dataset, rule, severity, n_bad, flagged)``.  ``flagged`` is what the
reference reports (most rules: n_bad > 0).  ``passed`` is false only for
missing columns, kept separately as in the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo
from tessera.functions.bands import exact_percentiles
from tessera.functions.stats import grouped_quantiles
from tessera.operators.rings import crossing_rings, ring_key

# Fixed values that must equal the reference's results.
TRIP_REQUIRED = ["trip_id", "start_time", "end_time", "start_station_id",
                 "start_lat", "start_lng", "end_lat", "end_lng", "member_type"]
SPENDING_REQUIRED = ["county_fips", "month", "year", "category", "spending_amount"]
BOUNDARY_REQUIRED = ["county_fips", "ring"]
MEMBER_TYPES = ["member", "casual"]
EXPECTED_CATEGORIES = ["restaurants", "retail", "grocery", "entertainment",
                       "transportation", "healthcare", "education", "services"]
FIPS_PATTERN = r"^\d{5}$"

_RULE_SCHEMA = "dataset string, rule string, severity string, n_bad long, flagged boolean"


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required names absent from the schema (no job runs)."""
    return [c for c in required if c not in df.columns]


def _rules(df: DataFrame, dataset: str, rules: list[tuple[str, str, Column, Column | None]]) -> DataFrame:
    """Evaluate (rule, severity, bad-count aggregate, flag-expr) in one pass."""
    aggs = [agg.cast("long").alias(f"r{i}") for i, (_, _, agg, _) in enumerate(rules)]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    structs = []
    for i, (name, sev, _, flag) in enumerate(rules):
        f = flag if flag is not None else (F.col(f"r{i}") > 0)
        structs.append(F.struct(F.lit(dataset).alias("dataset"), F.lit(name).alias("rule"),
                                F.lit(sev).alias("severity"), F.col(f"r{i}").alias("n_bad"),
                                f.alias("flagged")))
    return row.select(F.inline(F.array(*structs)))


def _schema_rows(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    miss = missing_columns(df, required)
    spark = df.sparkSession
    return spark.createDataFrame(
        [(dataset, "missing_columns", "issue", len(miss), len(miss) > 0)], _RULE_SCHEMA)


def _null_rules(df: DataFrame) -> list:
    return [(f"nulls:{c}", "warning", F.count_if(F.col(f"`{c}`").isNull()), None)
            for c in df.columns]


def _parse_fail(c: str, dtype) -> Column:
    """Value present but not parseable as a timestamp."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(False)
    return F.col(c).isNotNull() & F.col(c).cast("string").try_cast("timestamp_ntz").isNull()


def duration_minutes(start: str = "start_time", end: str = "end_time") -> Column:
    return F.timestamp_diff("SECOND", F.col(start).try_cast("timestamp_ntz"),
                            F.col(end).try_cast("timestamp_ntz")) / 60.0


def trip_rules(trips: DataFrame, dataset: str = "trips") -> DataFrame:
    """B01-B06, B08 count, B09 for a trips table."""
    if missing_columns(trips, TRIP_REQUIRED):
        return _schema_rows(trips, dataset, TRIP_REQUIRED)
    types = {f.name: f.dataType for f in trips.schema.fields}
    dur = duration_minutes()
    lat_bad = lambda c: (F.col(c) < -90) | (F.col(c) > 90)
    lng_bad = lambda c: (F.col(c) < -180) | (F.col(c) > 180)
    coords = (lat_bad("start_lat") | lng_bad("start_lng") | lat_bad("end_lat") | lng_bad("end_lng"))
    rules = [
        ("date_parse_errors", "issue",
         F.count_if(_parse_fail("start_time", types["start_time"])
                    | _parse_fail("end_time", types["end_time"])), None),
        ("invalid_coordinates", "warning", F.count_if(F.coalesce(coords, F.lit(False))), None),
        ("negative_durations", "issue", F.count_if(dur < 0), None),
        ("long_trips", "warning", F.count_if(dur > 1440), None),
        ("short_trips", "warning", F.count_if(dur < 1), None),
        # a null type is one value outside the domain, as in the reference's set difference
        ("invalid_member_types", "warning",
         F.count_distinct(F.when(~F.coalesce(F.col("member_type").isin(*MEMBER_TYPES), F.lit(False)),
                                 F.coalesce(F.col("member_type"), F.lit("\0null")))), None),
        *_null_rules(trips),
    ]
    base = _rules(trips, dataset, rules)
    out = _schema_rows(trips, dataset, TRIP_REQUIRED).unionByName(base)
    return out.unionByName(duplicate_id_rule(trips, "trip_id", dataset))


def invalid_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values outside the allowed domain."""
    dom = df.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    return df.select(column).distinct().join(F.broadcast(dom), column, "left_anti")


def member_type_rule(trips: DataFrame, dataset: str = "trips") -> DataFrame:
    bad = invalid_values(trips, "member_type", MEMBER_TYPES)
    return bad.agg(F.count(F.lit(1)).alias("n_bad")).select(
        F.lit(dataset).alias("dataset"), F.lit("invalid_member_types").alias("rule"),
        F.lit("warning").alias("severity"), "n_bad", (F.col("n_bad") > 0).alias("flagged"))


def duplicate_id_rule(df: DataFrame, id_col: str, dataset: str) -> DataFrame:
    """Rows beyond the first per id; null ids form one group.

    One shuffle on the id with partial aggregation per map task."""
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_bad")).select(
        F.lit(dataset).alias("dataset"), F.lit("duplicate_ids").alias("rule"),
        F.lit("issue").alias("severity"), "n_bad", (F.col("n_bad") > 0).alias("flagged"))


def duration_stats(trips: DataFrame) -> DataFrame:
    """Mean, median, std (n-1), min, max of trip minutes."""
    d = trips.select(duration_minutes().alias("d"))
    med = grouped_quantiles(d, [], "d", {"median_minutes": 0.5})
    return d.agg(F.avg("d").alias("mean_minutes"), F.stddev_samp("d").alias("std_minutes"),
                 F.min("d").alias("min_minutes"), F.max("d").alias("max_minutes")).select(
        "mean_minutes", med.select("median_minutes").scalar().alias("median_minutes"), "std_minutes",
        "min_minutes", "max_minutes")


def fips_invalid(c: str = "county_fips") -> Column:
    """Not five digits; a null renders as text that fails too."""
    return F.coalesce(~F.col(c).cast("string").rlike(FIPS_PATTERN), F.lit(True))


def spending_rules(spending: DataFrame, dataset: str = "spending") -> DataFrame:
    """B10-B13, B15 and null counts for a spending table."""
    if missing_columns(spending, SPENDING_REQUIRED):
        return _schema_rows(spending, dataset, SPENDING_REQUIRED)
    amt = F.col("spending_amount")
    q1, q3 = exact_percentiles(spending, "spending_amount", 0.25, 0.75)
    iqr = q3 - q1
    extreme = (amt < q1 - 3 * iqr) | (amt > q3 + 3 * iqr)
    zeros = F.count_if(amt == 0)
    rules = [
        ("invalid_fips", "warning", F.count_if(fips_invalid()), None),
        ("unusual_years", "warning", F.count_if((F.col("year") < 2020) | (F.col("year") > 2030)), None),
        ("invalid_months", "issue", F.count_if((F.col("month") < 1) | (F.col("month") > 12)), None),
        ("negative_spending", "warning", F.count_if(amt < 0), None),
        ("zero_spending", "warning", zeros, F.col("r4") > F.col("_n") * 0.1),
        ("extreme_values", "warning", F.count_if(F.coalesce(extreme, F.lit(False))), None),
        *_null_rules(spending),
    ]
    base = _rules(spending, dataset, rules)
    cats = invalid_values(spending, "category", EXPECTED_CATEGORIES).agg(
        F.count(F.lit(1)).alias("n_bad")).select(
        F.lit(dataset).alias("dataset"), F.lit("unexpected_categories").alias("rule"),
        F.lit("warning").alias("severity"), "n_bad", (F.col("n_bad") > 0).alias("flagged"))
    return _schema_rows(spending, dataset, SPENDING_REQUIRED).unionByName(base).unionByName(cats)


def spending_stats(spending: DataFrame) -> DataFrame:
    """Mean, median, std, min, max of spending_amount."""
    a = F.col("spending_amount")
    med = grouped_quantiles(spending, [], "spending_amount", {"median": 0.5})
    return spending.agg(F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"), F.min(a).alias("min"),
                        F.max(a).alias("max")).select(
        "mean", med.select("median").scalar().alias("median"), "std", "min", "max")


def ring_closed(ring) -> Column:
    """B16 without crossings: closed, ≥ 4 points, non-zero area."""
    r = F.col(ring) if isinstance(ring, str) else ring
    n = F.size(r)
    last = F.get(r, n - 1)  # null for an empty ring
    closed = (F.get(r, F.lit(0))["lng"] == last["lng"]) & (F.get(r, F.lit(0))["lat"] == last["lat"])
    return F.coalesce((n >= 4) & closed & (geo.ring_area_mercator_km2(r) > 0), F.lit(False))


def valid_rings(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``df`` with ``ring_valid``: closed, ≥ 4 points, non-zero area, no two edges that cross."""
    crossed = crossing_rings(df, ring).select(F.col("key").alias("_key"), F.lit(True).alias("_crossed"))
    return (df.withColumn("_key", ring_key(ring)).join(crossed, "_key", "left")
            .withColumn("ring_valid", ring_closed(ring) & F.col("_crossed").isNull()).drop("_key", "_crossed"))


def boundary_rules(boundaries: DataFrame, dataset: str = "boundaries") -> DataFrame:
    """B16, B17 and B10 for a boundaries table."""
    if missing_columns(boundaries, BOUNDARY_REQUIRED):
        return _schema_rows(boundaries, dataset, BOUNDARY_REQUIRED)
    empty = F.coalesce(F.size("ring") <= 0, F.lit(True))
    srid = F.col("srid") if "srid" in boundaries.columns else F.lit(None).cast("int")
    rules = [
        ("invalid_geometry", "issue", F.count_if(~empty & ~F.col("ring_valid")), None),
        ("empty_geometry", "warning", F.count_if(empty), None),
        ("missing_crs", "warning", F.count_if(srid.isNull()), None),
        ("non_wgs84_crs", "warning", F.count_if(srid.isNotNull() & (srid != 4326)), None),
        ("invalid_fips", "warning", F.count_if(fips_invalid()), None),
    ]
    return _schema_rows(boundaries, dataset, BOUNDARY_REQUIRED).unionByName(
        _rules(valid_rings(boundaries), dataset, rules))


def quality_report(rule_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per dataset records, issue/warning counts, status; overall row.

    ``counts`` is (dataset, total_records).  ``rollup`` adds the overall
    row (dataset NULL → 'ALL'); FAILED when any issue is flagged."""
    r = rule_rows.join(counts, "dataset")
    rep = r.rollup("dataset").agg(
        F.count_if((F.col("severity") == "issue") & F.col("flagged")).alias("issues"),
        F.count_if((F.col("severity") == "warning") & F.col("flagged")).alias("warnings"),
        F.sum(F.when(F.col("rule") == "missing_columns", F.col("total_records"))).alias("total_records"),
        F.max(F.when(F.col("rule") == "missing_columns", F.col("n_bad"))).alias("missing"),
    )
    return rep.select(
        F.coalesce(F.col("dataset"), F.lit("ALL")).alias("dataset"),
        F.col("total_records").cast("long").alias("total_records"),
        F.col("issues").cast("long").alias("issues"),
        F.col("warnings").cast("long").alias("warnings"),
        F.when(F.col("issues") > 0, "FAILED").otherwise("PASSED").alias("status"),
        (F.coalesce(F.col("missing"), F.lit(0)) == 0).alias("passed"),
    )


def spatial_validation(assigned: DataFrame, prepared: DataFrame) -> DataFrame:
    """Unassigned and duplicate stations, counties without stations,
    stations per county (mean, min, max), coordinate errors."""
    st = assigned.select("station_id", "county_fips", "lat", "lng")
    per_station = st.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    per_county = (st.where(F.col("county_fips").isNotNull()).groupBy("county_fips")
                  .agg(F.count(F.lit(1)).alias("n")))
    no_station = prepared.select("county_fips").join(per_county, "county_fips", "left_anti")
    bad_coord = ((F.col("lat") < -90) | (F.col("lat") > 90) | (F.col("lng") < -180) | (F.col("lng") > 180))
    return st.agg(
        F.count(F.lit(1)).alias("total_stations"),
        F.count_if(F.col("county_fips").isNull()).alias("unassigned_stations"),
        F.count_if(F.coalesce(bad_coord, F.lit(False))).alias("invalid_coordinates"),
    ).select(
        "*",
        per_station.select(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar().cast("long")
        .alias("duplicate_stations"),
        no_station.select(F.count(F.lit(1))).scalar().alias("counties_without_stations"),
        per_county.select(F.avg("n")).scalar().alias("stations_per_county_mean"),
        per_county.select(F.min("n")).scalar().alias("stations_per_county_min"),
        per_county.select(F.max("n")).scalar().alias("stations_per_county_max"),
    ).withColumn("passed", (F.col("unassigned_stations") == 0) & (F.col("invalid_coordinates") == 0))


def iqr_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> DataFrame:
    """``<col>_outlier`` outside [Q1 - t·IQR, Q3 + t·IQR] (exact quantiles)."""
    out = df
    for c in columns:
        x = F.col(c).cast("double")
        q1, q3 = exact_percentiles(df, c, 0.25, 0.75)
        iqr = q3 - q1
        out = out.withColumn(f"{c}_outlier",
                             F.coalesce((x < q1 - threshold * iqr) | (x > q3 + threshold * iqr), F.lit(False)))
    return out


def zscore_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """abs((x - mean) / std(n-1)) > threshold, plus ``any_outlier``."""
    out = df
    flags = []
    for c in columns:
        x = F.col(c).cast("double")
        mean = df.select(F.avg(x)).scalar()
        std = df.select(F.stddev_samp(x)).scalar()
        name = f"{c}_outlier"
        out = out.withColumn(name, F.coalesce(F.abs(F.try_divide(x - mean, std)) > threshold, F.lit(False)))
        flags.append(F.col(name))
    return out.withColumn("any_outlier", F.greatest(*flags) if len(flags) > 1 else flags[0])


def data_summary(df: DataFrame, top_n: int = 5) -> DataFrame:
    """One row per column: dtype, nulls, numeric stats, distinct count
    and (strings) the top values by count desc, value asc."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"{f.name}__nulls"))
        if f.name in numeric or f.name in strings:
            aggs.append(F.count_distinct(c).alias(f"{f.name}__nunique"))
        if f.name in numeric:
            x = c.cast("double")
            aggs += [F.avg(x).alias(f"{f.name}__mean"),
                     F.stddev_samp(x).alias(f"{f.name}__std"), F.min(x).alias(f"{f.name}__min"),
                     F.max(x).alias(f"{f.name}__max")]
    wide = df.agg(*aggs)
    if numeric:
        # Medians of all numeric columns in one two-level selection keyed by column.
        long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numeric]).unpivot(
            [], numeric, "column_name", "v")
        meds = grouped_quantiles(long, ["column_name"], "v", {"median": 0.5})
        for c in numeric:
            wide = wide.withColumn(f"{c}__median", meds.where(F.col("column_name") == c)
                                   .select("median").scalar())
    rows = []
    for f in df.schema.fields:
        n = f.name
        get = lambda s: F.col(f"`{n}__{s}`") if f"{n}__{s}" in wide.columns else F.lit(None)
        rows.append(F.struct(
            F.lit(n).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
            get("nulls").cast("long").alias("null_count"),
            get("nunique").cast("long").alias("unique_values"),
            get("mean").cast("double").alias("mean"), get("median").cast("double").alias("median"),
            get("std").cast("double").alias("std"), get("min").cast("double").alias("min"),
            get("max").cast("double").alias("max")))
    summary = wide.select(F.inline(F.array(*rows)))
    if not strings:
        return summary.withColumn("top_values", F.lit(None).cast("string"))
    tops = None
    for n in strings:
        vc = (df.groupBy(F.col(f"`{n}`").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
              .where(F.col("value").isNotNull()))
        # Top values per column: a top-k over the (small) value counts.
        top = (vc.orderBy(F.desc("cnt"), F.asc("value")).limit(top_n)
               .agg(F.array_join(F.transform(
                   F.array_sort(F.collect_list(F.struct(-F.col("cnt").alias("k"), F.col("value").alias("v"),
                                                        F.col("cnt").alias("c")))),
                   lambda s: F.concat(s["v"], F.lit(":"), s["c"].cast("string"))), ",").alias("top_values"))
               .select(F.lit(n).alias("column_name"), "top_values"))
        tops = top if tops is None else tops.unionByName(top)
    return summary.join(tops, "column_name", "left")


def sample_rows(trips: DataFrame, n: int = 1000) -> DataFrame:
    """The first n trips by trip_id (distributed top-k)."""
    return trips.orderBy("trip_id", "start_time").limit(n)
