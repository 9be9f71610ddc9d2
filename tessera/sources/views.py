"""Logical inputs of the engine as deterministic views over the driver tables.

The engine works on trips, spending, county boundaries, population and
demographics.  The driver supplies TPC-H-like tables, so each logical
table is a Spark plan over them (see FIXTURES.md §3).  Every view is lazy:
callers' projections and filters are pushed through it into the scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.stats import grouped_quantiles
from tessera.sources.tables import table

# Fixed values of the adapter (FIXTURES.md §3).
CATEGORY_BY_PART_TYPE = {
    "STANDARD": "restaurants",
    "PROMO": "retail",
    "ECONOMY": "grocery",
    "MEDIUM": "entertainment",
    "SMALL": "transportation",
    "LARGE": "healthcare",
}
SEGMENT_SHARES = [
    ("AUTOMOBILE", "age_18_34_pct"),
    ("BUILDING", "age_35_54_pct"),
    ("FURNITURE", "age_55_plus_pct"),
    ("HOUSEHOLD", "bachelor_plus_pct"),
    ("MACHINERY", "high_school_pct"),
]


def station_lat(station_id: Column) -> Column:
    return F.lit(40.005) + F.pmod(station_id * 37, F.lit(520)) / 100


def station_lng(station_id: Column) -> Column:
    return F.lit(-89.995) + F.pmod(station_id * 91, F.lit(510)) / 100


def fips(key: Column) -> Column:
    return F.lpad(key.cast("string"), 5, "0")


def _trip_base(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    if start is not None:
        # Trips start less than a day after the order date: a superset
        # predicate on o_orderdate that the Parquet scan can push down.
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY"))
    if end is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    # Both sides grow with the data: a shuffle (sort-merge) join on the
    # order key; AQE splits skewed order keys.
    return li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")


def _trip_columns(start: Column, end: Column) -> list[Column]:
    end_id = F.pmod(F.col("l_suppkey") + F.col("l_partkey"), F.lit(97))
    return [
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("trip_id"),
        start.alias("start_time"),
        end.alias("end_time"),
        F.col("l_suppkey").alias("start_station_id"),
        end_id.alias("end_station_id"),
        station_lat(F.col("l_suppkey")).alias("start_lat"),
        station_lng(F.col("l_suppkey")).alias("start_lng"),
        station_lat(end_id).alias("end_lat"),
        station_lng(end_id).alias("end_lng"),
        F.when(F.col("l_linestatus") == "O", "member").otherwise("casual").alias("member_type"),
    ]


def trip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows behind ``trips``, with only the columns that ``as_trips`` reads."""
    return _trip_base(spark, sf_dir).drop("o_orderkey", "l_shipdate")


def as_trips(base: DataFrame) -> DataFrame:
    offset = F.pmod(F.col("l_partkey"), F.lit(24)) * 60 + F.pmod(F.col("l_suppkey"), F.lit(60))
    t0 = F.timestamp_add("MINUTE", offset, F.col("o_orderdate"))
    t1 = F.timestamp_add("MINUTE", F.col("l_quantity").cast("long"), t0)
    return base.select(*_trip_columns(t0, t1))


def trips(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per ride (lineitem ⋈ orders).  ``start`` / ``end`` (dates,
    end exclusive) keep only trips starting in that window and prune the
    orders scan (A04's year/month source)."""
    out = as_trips(_trip_base(spark, sf_dir, start, end))
    if start is not None:
        out = out.where(F.col("start_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("start_time") < F.lit(end).cast("timestamp_ntz"))
    return out


def trips_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order date → ship date as start → end; ids repeat."""
    base = _trip_base(spark, sf_dir)
    return base.select(*_trip_columns(F.col("o_orderdate"), F.col("l_shipdate")))


def trips_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with known faults: times as text, some unreadable, latitudes out of range, unknown and null member types."""
    t = trips(spark, sf_dir)
    start, end = F.col("start_station_id"), F.col("end_station_id")
    return t.withColumns({
        "start_time": F.when(F.pmod(start, F.lit(10)) == 3, "not a date").otherwise(F.col("start_time").cast("string")),
        "end_time": F.col("end_time").cast("string"),
        "start_lat": F.when(F.pmod(end, F.lit(7)) == 1, F.col("start_lat") + 100).otherwise(F.col("start_lat")),
        "member_type": F.when(F.pmod(start, F.lit(13)) == 5, "vip").when(F.pmod(start, F.lit(13)) != 6, F.col("member_type"))})


def spending_messy(spending: DataFrame) -> DataFrame:
    """Spending with known faults: bad FIPS codes, months, categories, negative and zero amounts."""
    month = F.col("month")
    return spending.withColumns({
        "county_fips": F.when(month == 3, F.concat(F.lit("X"), "county_fips")).otherwise(F.col("county_fips")),
        "month": F.when(month == 12, 13).otherwise(month),
        "category": F.when((F.col("category") == "retail") & (F.col("year") == 1997), "gifts")
        .when(month != 5, F.col("category")),
        "spending_amount": F.when(month == 7, -F.col("spending_amount")).when(month == 8, 0.0)
        .otherwise(F.col("spending_amount"))})


def boundaries_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries with known faults: crossing and empty rings, missing and foreign reference systems, bad FIPS codes."""
    b = boundaries(spark, sf_dir)
    n, r = F.col("county_fips").cast("int"), F.col("ring")
    return b.withColumns({
        "ring": F.when(n % 5 == 1, F.array(r[0], r[2], r[1], r[3], r[0])).when(n % 5 == 2, F.slice(r, 1, 0)).otherwise(r),
        "srid": F.when(n % 4 == 1, 3857).when(n % 4 != 0, F.col("srid")),
        "county_fips": F.when(n % 6 == 5, "BAD").otherwise(F.col("county_fips"))})


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit-square polygon per nation, EPSG:4326."""
    n = table(spark, sf_dir, "nation")
    x0 = (F.lit(-90) + F.pmod(F.col("n_nationkey"), F.lit(5))).cast("double")
    y0 = (F.lit(40) + F.floor(F.col("n_nationkey") / 5)).cast("double")

    def pt(x, y):
        return F.struct(x.alias("lng"), y.alias("lat"))

    ring = F.array(pt(x0, y0), pt(x0 + 1, y0), pt(x0 + 1, y0 + 1), pt(x0, y0 + 1), pt(x0, y0))
    return n.select(
        fips(F.col("n_nationkey")).alias("county_fips"),
        F.col("n_name").alias("county_name"),
        ring.alias("ring"),
        F.lit(4326).alias("srid"),
        F.col("n_regionkey").alias("region_key"),
    )


def _customers(spark: SparkSession, sf_dir: str, counties: Sequence[str] | None) -> DataFrame:
    """Customers, of some counties only if asked: the FIPS set reaches the scan as a set of nation keys."""
    cust = table(spark, sf_dir, "customer")
    if counties is None:
        return cust
    return cust.where(F.col("c_nationkey").isin(*[int(c) for c in counties]))


def spending(spark: SparkSession, sf_dir: str, counties: Sequence[str] | None = None) -> DataFrame:
    """County × year × month × category spending (money summed exactly)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = _customers(spark, sf_dir, counties).select("c_custkey", fips(F.col("c_nationkey")).alias("county_fips"))
    category = None
    for word, cat in CATEGORY_BY_PART_TYPE.items():
        cond = F.col("p_type").contains(word)
        category = F.when(cond, cat) if category is None else category.when(cond, cat)
    amount = (F.col("l_extendedprice").cast("decimal(18,2)")
              * (F.lit(1) - F.col("l_discount")).cast("decimal(18,2)"))
    # customers meet the orders, not the line items: once they are too many to broadcast, the smaller table is shuffled for them
    owned = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "county_fips", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    # so are year, month and category: once for each order and part
    part = table(spark, sf_dir, "part").select("p_partkey", category.alias("category"))
    j = (li.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(part, F.col("l_partkey") == F.col("p_partkey")))
    agg = (j.select("county_fips", "year", "month", "category", amount.alias("amount"))
        .groupBy("county_fips", "year", "month", "category")
        .agg(F.sum("amount").cast("double").alias("spending_amount")))
    return agg.withColumn(
        "date", F.make_timestamp_ntz(F.col("year"), F.col("month"), F.lit(1),
                                     F.lit(0), F.lit(0), F.lit(0)))


def population(spark: SparkSession, sf_dir: str, counties: Sequence[str] | None = None) -> DataFrame:
    """County × year population: 1000·customers (2022), 1010·customers (2023)."""
    cust = (_customers(spark, sf_dir, counties).groupBy("c_nationkey")
            .agg(F.count(F.lit(1)).alias("n")))
    area = boundaries(spark, sf_dir).select(
        "county_fips", geo.ring_area_spherical_km2("ring").alias("area"))
    years = F.explode(F.array(
        F.struct(F.lit(2022).alias("year"), F.lit(1000).alias("mult")),
        F.struct(F.lit(2023).alias("year"), F.lit(1010).alias("mult"))))
    p = cust.select(fips(F.col("c_nationkey")).alias("county_fips"), "n", years.alias("y"))
    p = p.select("county_fips", F.col("y.year").alias("year"),
                 (F.col("n") * F.col("y.mult")).cast("long").alias("population"))
    return (p.join(area, "county_fips", "left")
            .select("county_fips", "year", "population",
                    F.try_divide(F.col("population").cast("double"), F.col("area"))
                    .alias("population_density_per_sq_km")))


def demographics(spark: SparkSession, sf_dir: str, counties: Sequence[str] | None = None) -> DataFrame:
    """Per county: 40000 + median account balance, five segment shares."""
    cust = _customers(spark, sf_dir, counties).select("c_nationkey", "c_acctbal", "c_mktsegment")
    shares = [
        F.avg((F.col("c_mktsegment") == seg).cast("double")).alias(name)
        for seg, name in SEGMENT_SHARES
    ]
    d = cust.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"), *shares)
    # Exact median without a whole-nation buffer.
    med = grouped_quantiles(cust, ["c_nationkey"], "c_acctbal", {"med": 0.5})
    d = d.join(med, "c_nationkey", "left").withColumn("median_income", F.lit(40000.0) + F.col("med"))
    area = boundaries(spark, sf_dir).select(
        "county_fips", geo.ring_area_spherical_km2("ring").alias("area"))
    d = d.withColumn("county_fips", fips(F.col("c_nationkey")))
    return (d.join(area, "county_fips", "left")
            .select("county_fips", "median_income", *[n for _, n in SEGMENT_SHARES],
                    F.try_divide(F.col("n_customers") * 1010.0, F.col("area"))
                    .alias("population_density")))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cluster labels per county for the label-driven metrics."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    cluster = (F.when(F.pmod(F.col("n_nationkey"), F.lit(7)) == 3, F.lit(-1))
               .otherwise(F.pmod(F.col("n_nationkey"), F.lit(4))))
    return n.select(fips(F.col("n_nationkey")).alias("county_fips"),
                    cluster.cast("int").alias("cluster"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
