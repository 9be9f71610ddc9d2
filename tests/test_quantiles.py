"""Exact quantiles against numpy, with ties, nulls and groups of all sizes; passes over the trips' join."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.plans.context import Context


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_of_large_and_small_groups(spark, keys):
    rng = np.random.default_rng(5)
    rows = [("large", float(v)) for v in rng.lognormal(3, 2, 9000)] + [("tied", float(v)) for v in rng.integers(1, 6, 5000)]
    rows += [("small", 2.0), ("small", 7.0), ("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = {"low": 0.25, "mid": 0.5, "high": 0.99}
    got = stats.grouped_quantiles(df, keys, "v", probs).collect()
    for name in {g for g, _ in rows} if keys else {None}:
        own = [v for g, v in rows if v is not None and name in (None, g)]
        found = [r for r in got if not keys or r["g"] == name]
        assert len(found) == bool(own)
        for r in found:
            assert [r[p] for p in probs] == pytest.approx([np.quantile(own, q) for q in probs.values()], rel=1e-12)


def test_quantiles_of_two_values_share_a_pass(spark):
    df = spark.range(12000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("a"), F.pmod("id", F.lit(11)).cast("double").alias("b"))
    values, probs = {"a": F.col("a"), "b": F.col("b")}, {"mid": 0.5, "top": 0.9}
    sketch = df.groupBy("g").agg(*stats.quantile_sketch(values, probs))
    for r in stats.quantiles_from_sketch(df, ["g"], sketch, values, probs).collect():
        own = [i for i in range(12000) if i % 3 == r["g"]]
        for name, q in probs.items():
            assert r[f"a_{name}"] == pytest.approx(np.quantile([i * 1.5 for i in own], q))
            assert r[f"b_{name}"] == pytest.approx(np.quantile([i % 11 for i in own], q))


def test_no_row_below_a_bracket_is_multiplied(spark):
    df = spark.range(40000).select(F.col("id").cast("double").alias("v"))
    values, probs = {"q": F.col("v")}, {p: 0.5 for p in "abcdef"}
    sketch = stats.cut_lineage(df.agg(*stats.quantile_sketch(values, probs)))
    plan = stats.quantiles_from_sketch(df, [], sketch, values, probs)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "arrayfilter(array(CASE" not in plan.split("posexplode")[1].lower()


def test_trips_are_joined_once(spark, tmp_path):
    import datetime
    d = str(tmp_path)
    day = datetime.datetime(2023, 1, 1)
    li = [(o, n, 10 * o + n, (o * 7 + n) % 5, float(n + 5), "O" if o % 2 else "F") for o in range(30) for n in range(3)]
    spark.createDataFrame(li, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_linestatus string"
                          ).withColumn("l_shipdate", F.lit(day).cast("timestamp_ntz")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit(day).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    ctx = Context(spark, d)
    trips = ctx.enriched_trips()
    assert trips.count() == len(li)
    plan = trips._jdf.queryExecution().optimizedPlan().toString()
    assert "orders.parquet" not in plan and "o_orderkey" not in plan
    same = ["trip_id", "start_time", "end_time", "start_station_id", "end_station_id", "start_lat", "end_lng", "member_type"]
    assert sorted(trips.select(*same).collect()) == sorted(ctx.trips().select(*same).collect())


def test_few_bytes_with_much_work_are_many_tasks(spark, monkeypatch):
    from tessera.operators import density, neighbors
    from tessera.session import cut_lineage, spread
    points = cut_lineage(spark.range(900).select(F.col("id").alias("pid"), (F.col("id") % 30).cast("double").alias("x"),
                                                 F.floor(F.col("id") / 30).cast("double").alias("y")).coalesce(1))
    assert spread(points, "x", rows=100).rdd.getNumPartitions() == 9
    sizes = []
    for m in (density, neighbors):
        monkeypatch.setattr(m, "spread", lambda df, *c, rows: (sizes.append(rows), spread(df, *c, rows=100))[1])
    links = density.connected_components(points, density.range_links(points, 1.0))
    assert {r["component"] for r in links.collect()} == {0}
    assert density.connected_components(points, density.range_links(points, 0.99)).where("pid != component").count() == 0
    near = neighbors.knn_join(points, points.withColumnRenamed("pid", "tid"), 1, exclude_self=True)
    assert near.where("dist = 1.0").count() == 900 and len(sizes) == 3


def test_customers_meet_orders_before_line_items(spark, tmp_path):
    import datetime
    from tessera.sources import views
    d = str(tmp_path)
    day = datetime.datetime(2023, 4, 1)
    spark.createDataFrame([(1, 7, 100.0, 0.1), (1, 8, 50.0, 0.0), (2, 7, 10.0, 0.5), (3, 7, 1.0, 0.0), (None, 7, 5.0, 0.0)],
                          "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, 4, day), (2, 5, day), (2, 5, day), (3, None, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"
                          ).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(4, 0), (5, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(7, "PROMO TIN"), (8, "SMALL TIN")], "p_partkey long, p_type string").write.parquet(f"{d}/part.parquet")
    out = views.spending(spark, d)
    got = {(r["county_fips"], r["category"]): r["spending_amount"] for r in out.collect()}
    assert got == {("00000", "retail"): 90.0, ("00000", "transportation"): 50.0, ("00001", "retail"): 10.0}
    depth = {k: line.index("Join") for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line
             for k in ("o_custkey", "l_orderkey") if f"({k}#" in line}
    assert depth["o_custkey"] > depth["l_orderkey"]


def test_medians_by_histogram(spark, monkeypatch):
    monkeypatch.setattr(stats, "LEAST", 20)
    rng = np.random.default_rng(9)
    groups = {"wide": rng.normal(0, 1e6, 3001), "narrow": 1e9 + rng.random(3000), "far": np.r_[rng.random(2000), 1e300, -1e300],
              "tied": np.r_[np.full(1500, 7.0), rng.random(700) * 14], "signs": np.r_[np.full(50, -1e308), np.full(50, 1e308)],
              "zero": np.array([-0.0, 0.0, 5e-324, -5e-324]), "one": np.array([4.0])}
    rows = [(g, float(v), float(v) * 3 if g == "narrow" else None) for g, vs in groups.items() for v in vs] + [("one", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    for p in (0.5, 0.9):
        got = {r["g"]: r for r in stats.grouped_medians(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, p).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            if g != "signs" or p != 0.5:  # halfway between them is no double's difference
                assert got[g]["a"] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-320), (g, p)
        assert got["narrow"]["b"] == pytest.approx(np.quantile(groups["narrow"], p) * 3, rel=1e-12) and got["wide"]["b"] is None


def test_no_sketch_in_the_pass_over_the_trips(spark, monkeypatch):
    """The statistics of all trips stay plain sums: sketches take them out of generated code."""
    from tessera.operators import spatial
    seen = []
    for module in (spatial, stats):
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=stats.cut_lineage: seen.append(
            df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    trips = spark.range(50).select(
        F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("string").alias("county_fips"), F.col("id").alias("trip_id"), F.lit(True).alias("is_inter_county"),
        F.lit("member").alias("member_type"), *[(F.col("id") * k).alias(c) for k, c in enumerate(
            ("trip_duration_minutes", "trip_distance_km", "trip_speed_kmh"), 1)])
    got = {r["county_fips"]: r["median_trip_distance_km"] for r in spatial.county_aggregation(trips).collect()}
    assert got == {str(g): 2 * np.median([i for i in range(50) if i % 5 and i % 2 == g]) for g in (0, 1)}
    assert seen and not any("percentile_approx" in plan or "ObjectHashAggregate" in plan for plan in seen)


def test_spending_reads_dates_and_categories_before_the_line_items(spark, tmp_path):
    import datetime

    from tessera.sources import views
    d, day = str(tmp_path), datetime.datetime(2023, 4, 5)
    spark.createDataFrame([(k % 4, k % 3, 10.0, 0.5) for k in range(12)], "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double"
                          ).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, k % 2, day) for k in range(4)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(0, 3), (1, 123456)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(0, "PROMO TIN"), (1, "OTHER"), (2, None)], "p_partkey long, p_type string").write.parquet(f"{d}/part.parquet")
    df = views.spending(spark, d)
    got = {(r["county_fips"], r["year"], r["month"], r["category"]): r["spending_amount"] for r in df.collect()}
    assert got == {(f, 2023, 4, "retail"): 10.0 for f in ("00003", "12345")} | {(f, 2023, 4, None): 20.0 for f in ("00003", "12345")}
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [k for k, line in enumerate(plan) if "Join Inner" in line]
    assert min(k for k, line in enumerate(plan) if "Contains" in line) > min(joins) and not any("year(" in line for line in plan[:min(joins)])
