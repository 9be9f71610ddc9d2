"""Rings of any size as tables of edges: crossings within a ring (B16) and points inside polygons.

A ring is ARRAY<STRUCT<lng, lat>>.  It is unfolded once into edges; nothing carries a whole ring through a join.

* What an edge (or a polygon's box) may touch is found on nested grids: each is filed on the grid whose cells are just
  larger than itself, so it lies in at most four cells, and it looks for others on that grid and each coarser one in use.
* A point's ray meets only edges at its own height: edges are filed by strips of their polygon, as many as it has edges, so a
  point is tested against a few edges however long the ring is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import broadcast_if_bounded, cut_lineage

MAX_STRIPS = 1 << 16  # of one polygon
FINEST = -40  # cells of 2^-40 degrees


def ring_key(*parts: str) -> Column:
    """Names a ring by what it holds, so that repeated rows count once."""
    return F.struct(*[F.hash(*parts).alias("a"), F.xxhash64(*parts).alias("b")])


def ring_edges(rings: DataFrame, keep: list[str], ring: str = "ring") -> DataFrame:
    """(keep..., i, ax, ay, bx, by): the edges of each ring in order, from 1; those with a missing end are left out."""
    n = F.size(ring)
    ends = F.arrays_zip(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                        F.slice(ring, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return (rings.where(n >= 2).select(*keep, F.posexplode(ends).alias("i", "e"))
            .select(*keep, (F.col("i") + 1).alias("i"), F.col("e.a.lng").alias("ax"), F.col("e.a.lat").alias("ay"),
                    F.col("e.b.lng").alias("bx"), F.col("e.b.lat").alias("by"))
            .where("ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND by IS NOT NULL"))


def _grid(extent: Column) -> Column:
    """The grid whose cells (edge 2^grid) are at least that large."""
    return F.when(extent > 0, F.greatest(F.ceil(F.log2(extent)), F.lit(FINEST))).otherwise(F.lit(FINEST)).cast("int")


def _cells(df: DataFrame, low: tuple[str, str], high: tuple[str, str]) -> DataFrame:
    """One row per cell of grid ``g`` that holds a corner of the box, as (cx, cy)."""
    def both(lo: str, hi: str) -> Column:
        size = F.pow(F.lit(2.0), F.col("g"))
        return F.array_distinct(F.array(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))

    return (df.withColumn("cx", F.explode(both(low[0], high[0])))
            .withColumn("cy", F.explode(both(low[1], high[1]))))


def _turn(a: str, b: str, c: str) -> Column:
    """Side of the line a-b on which c lies."""
    x = {p: (F.col(f"{p}x"), F.col(f"{p}y")) for p in (a, b, c)}
    return F.signum((x[b][0] - x[a][0]) * (x[c][1] - x[a][1]) - (x[b][1] - x[a][1]) * (x[c][0] - x[a][0]))


def crossing_rings(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """(key): the rings in which two edges cross, each once; edges that only touch or share an end don't cross.

    Rows are linear in the edges (four cells on each grid in use), as long as edges of one size don't crowd one cell; keys are
    cells, so one large ring is spread over all tasks.  Null and empty rings and edges without length never cross.
    """
    own = rings.select(ring_key(ring).alias("key"), F.col(ring).alias("ring")).where(F.size("ring") >= 4).dropDuplicates(["key"])
    e = ring_edges(own, ["key"])
    for c, pair in {"lx": "ax, bx", "ly": "ay, by"}.items():
        e = e.withColumn(c, F.expr(f"least({pair})")).withColumn(c.replace("l", "h"), F.expr(f"greatest({pair})"))
    e = cut_lineage(e.where("ax <> bx OR ay <> by").withColumn(
        "home", _grid(F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly")))))
    grids = e.groupBy("key").agg(F.collect_set("home").alias("grids"))  # at most some sixty of a ring
    filed = _cells(e.withColumn("g", F.col("home")), ("lx", "ly"), ("hx", "hy")).select(
        "key", "g", "cx", "cy", F.col("i").alias("j"), F.col("ax").alias("cx1"), F.col("ay").alias("cy1"),
        F.col("bx").alias("dx1"), F.col("by").alias("dy1"))
    filed = filed.withColumnsRenamed({"cx": "gx", "cy": "gy", "cx1": "cx", "cy1": "cy", "dx1": "dx", "dy1": "dy"})
    seek = e.join(broadcast_if_bounded(grids.persist()), "key").withColumn(
        "g", F.explode(F.filter("grids", lambda g: g >= F.col("home"))))
    seek = _cells(seek, ("lx", "ly"), ("hx", "hy")).select(
        "key", "g", F.col("cx").alias("gx"), F.col("cy").alias("gy"), "i", "home", "ax", "ay", "bx", "by")
    pairs = seek.join(filed, ["key", "g", "gx", "gy"]).where((F.col("home") < F.col("g")) | (F.col("i") < F.col("j")))
    crosses = (_turn("a", "b", "c") * _turn("a", "b", "d") < 0) & (_turn("c", "d", "a") * _turn("c", "d", "b") < 0)
    return pairs.where(crosses).select("key").distinct()


def points_in_rings(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(station_id, county_fips) of points (station_id, lat, lng) strictly inside polygons (county_fips, ring, min_lng,
    max_lng, min_lat, max_lat).  A point on an edge is not inside; one inside several polygons has several rows.

    Points meet the boxes around them on nested grids, then count the edges to their right among those of their strip.
    """
    p = cut_lineage(polygons.select("county_fips", "ring", "min_lng", "max_lng", "min_lat", "max_lat").where(F.size("ring") > 3)
                    .withColumn("key", ring_key("county_fips", "ring"))
                    .withColumn("strips", F.least(F.size("ring") - 1, F.lit(MAX_STRIPS)))
                    .withColumn("g", _grid(F.greatest(F.col("max_lng") - F.col("min_lng"), F.col("max_lat") - F.col("min_lat")))))

    def strip(y: str) -> Column:
        share = F.try_divide(F.col(y) - F.col("min_lat"), F.col("max_lat") - F.col("min_lat"))
        return F.coalesce(F.floor(share * F.col("strips")), F.lit(0)).cast("int")

    boxes = _cells(p.drop("ring"), ("min_lng", "min_lat"), ("max_lng", "max_lat"))
    grids = p.select(F.collect_set("g")).scalar()  # as many as there are sizes of boxes by powers of two
    seek = points.select("station_id", "lat", "lng", F.explode(grids).alias("g"))
    size = F.pow(F.lit(2.0), F.col("g"))
    seek = seek.withColumn("cx", F.floor(F.col("lng") / size)).withColumn("cy", F.floor(F.col("lat") / size))
    near = cut_lineage(
        seek.join(broadcast_if_bounded(boxes.persist()), ["g", "cx", "cy"])
        .where("lng > min_lng AND lng < max_lng AND lat > min_lat AND lat < max_lat")
        .select("station_id", "lng", "lat", "county_fips", "key", strip("lat").alias("strip")))

    edges = ring_edges(p.dropDuplicates(["key"]), ["key", "min_lat", "max_lat", "strips"])
    edges = edges.withColumn("strip", F.explode(F.sequence(
        F.least(strip("ay"), strip("by")), F.greatest(strip("ay"), strip("by"))))).select("key", "strip", "ax", "ay", "bx", "by")
    px, py, ax, ay, bx, by = (F.col(c) for c in ("lng", "lat", "ax", "ay", "bx", "by"))
    right = ((ay > py) != (by > py)) & F.coalesce(px < ax + F.try_divide((py - ay) * (bx - ax), by - ay), F.lit(False))
    on = (((bx - ax) * (py - ay) - (by - ay) * (px - ax) == 0) & (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx))
          & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by)))
    inside = (near.select("lng", "lat", "key", "strip").distinct().join(edges, ["key", "strip"])
              .groupBy("lng", "lat", "key").agg(F.count_if(right).alias("n"), F.count_if(on).alias("on"))
              .where((F.col("n") % 2 == 1) & (F.col("on") == 0)).select("lng", "lat", "key"))
    return near.join(inside, ["lng", "lat", "key"], "left_semi").select("station_id", "county_fips")
