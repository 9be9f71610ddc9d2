"""Exact neighbour search among points of any number of columns, by pivots and the triangle inequality.

A bounded hash sample of the distinct places are pivots; every place belongs to the cell of its nearest pivot.  With the
distance d from a point to a cell's pivot and the cell's radius R, no place of the cell is nearer than d - R and none
farther than d + R, and a place at distance r from the pivot is no nearer than |d - r|.  So a few cells are joined for
each point, by cell, and few of their places are measured.  The table of cells (at most ``MOST_PIVOTS``) travels as a
constant of the plan.  Dense regions hold more pivots, as these are drawn from the places.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import broadcast_if_bounded, cut_lineage

MOST_PIVOTS = 1024


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance of two points given as columns."""
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def _constant(rows: list[dict], kind: str) -> Column:
    """A bounded table as one array literal of the plan."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def _coordinates(features: Sequence[str]) -> str:
    return ", ".join(f"{f}: double" for f in features)


def cells_of(places: DataFrame, features: Sequence[str]) -> DataFrame:
    """``places`` with their ``cell`` and the distance ``r`` to its pivot; cells hold about as many places as there are cells."""
    n = places.count()
    most = min(MOST_PIVOTS, max(1, math.isqrt(n)))
    drawn = places.select(*features).distinct().orderBy(F.xxhash64(*features), *features).limit(most).collect()
    pivots = _constant([{"cell": j, **{f: row[f] for f in features}} for j, row in enumerate(drawn)],
                       f"cell: int, {_coordinates(features)}")
    own = [F.col(f) for f in features]
    nearest = F.array_min(F.transform(pivots, lambda p: F.struct(
        distance(own, [p[f] for f in features]).alias("r"), p["cell"].alias("cell"))))
    return places.withColumn("at", nearest).select(*places.columns, "at.cell", "at.r")


def _cell_table(placed: DataFrame, features: Sequence[str], extra: Sequence[Column] = ()) -> list[dict]:
    """One row a cell: pivot (its own nearest place, the pivot itself), radius, number of places and ``extra``."""
    center = F.min(F.struct("r", *features))
    rows = placed.groupBy("cell").agg(F.max("r").alias("radius"), center.alias("center"), F.sum("weight").alias("n"), *extra).collect()
    return [row.asDict(recursive=True) | {f: row["center"][f] for f in features} for row in rows]


def knn(places: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(pid, tid, dist, rank): the nearest places of each place until they weigh ``k``, itself aside, by (dist, tid).

    ``places`` has pid, the features and ``weight`` (points at that place).  Fewer rows where fewer places exist.
    """
    placed = cut_lineage(cells_of(places.select("pid", "weight", *features), features))
    cells = _constant([{"cell": c["cell"], "radius": c["radius"], "n": c["n"], **{f: c[f] for f in features}}
                       for c in _cell_table(placed, features)], f"cell: int, radius: double, n: bigint, {_coordinates(features)}")
    own = [F.col(f) for f in features]

    def reach(c: Column) -> Column:
        d = distance(own, [c[f] for f in features])
        return F.struct((d + c["radius"]).alias("far"), (d - c["radius"]).alias("low"), d.alias("d"), c["cell"].alias("cell"), c["n"].alias("n"))

    # the nearest cells that surely hold the place and k others bound the distance
    enough = F.lit(k) + F.col("weight")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("bound"))
    bound = F.aggregate("near", start, lambda a, c: F.struct(
        (a["n"] + c["n"]).alias("n"),
        F.when((a["n"] < enough) & (a["n"] + c["n"] >= enough), c["far"]).otherwise(a["bound"]).alias("bound")))["bound"]
    asked = placed.withColumn("near", F.array_sort(F.transform(cells, reach))).withColumn("bound", bound)
    asked = asked.select("pid", *features, "bound", F.explode(F.filter("near", lambda c: c["low"] <= F.col("bound") * (1 + 1e-9))).alias("c"))
    other = placed.select(F.col("pid").alias("tid"), F.col("cell"), "r", F.col("weight").alias("tw"), *[F.col(f).alias(f"t_{f}") for f in features])
    pairs = asked.select("pid", *features, "bound", "c.d", "c.cell").join(other, "cell").where("pid != tid")
    pairs = pairs.where(F.abs(F.col("d") - F.col("r")) <= F.col("bound") * (1 + 1e-9))
    pairs = pairs.select("pid", "tid", "tw", distance(own, [F.col(f"t_{f}") for f in features]).alias("dist"), "bound")
    pairs = pairs.where(F.col("dist") <= F.col("bound") * (1 + 1e-9))
    nearest = Window.partitionBy("pid").orderBy("dist", "tid")
    pairs = pairs.withColumn("rank", F.row_number().over(nearest)).withColumn(
        "before", F.coalesce(F.sum("tw").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return pairs.where(F.col("before") < k).select("pid", "tid", "dist", "rank")


def core_distances(places: DataFrame, features: Sequence[str], min_samples: int) -> DataFrame:
    """``places`` with ``core``: the distance within which lie ``min_samples`` points, the point itself counted.

    0 where the place holds that many; the farthest place's distance where there are fewer points in all.
    """
    near = knn(places, features, max(min_samples - 1, 1)).join(
        places.select(F.col("pid").alias("tid"), F.col("weight").alias("tw")), "tid")
    own = places.select("pid", F.col("weight").alias("own"))
    so_far = Window.partitionBy("pid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    near = near.join(own, "pid").withColumn("before", F.col("own") + F.coalesce(F.sum("tw").over(so_far), F.lit(0)))
    core = near.where(F.col("before") < min_samples).groupBy("pid").agg(F.max("dist").alias("core"))
    return places.join(core, "pid", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))


def least_edges(placed: DataFrame, features: Sequence[str]) -> DataFrame:
    """(comp, other, a, b, w): for each component the least edge to another, in order of weight and ends.

    ``placed`` has pid, features, weight, cell, r, core and comp; an edge weighs the greatest of its length and the core
    distances of its ends.  A cell's nearest places to the pivot of its first and its last component give edges to start
    with; only cells that hold another component and may hold a lesser edge are joined.
    """
    own = [F.col(f) for f in features]
    reps = placed.groupBy("cell", "comp").agg(
        F.max("r").alias("radius"), F.min("core").alias("core"), F.sum("weight").alias("weight"),
        F.min(F.struct("r", "pid", "core", *features)).alias("rep"))
    pid = placed.schema["pid"].dataType.simpleString()
    rows = reps.groupBy("cell").agg(
        F.max("radius").alias("radius"), F.min("core").alias("core"), F.min("comp").alias("first"), F.max("comp").alias("last"),
        F.min_by("rep", "comp").alias("lo"), F.max_by("rep", "comp").alias("hi")).collect()
    pivot = {r["cell"]: r["center"] for r in placed.groupBy("cell").agg(F.min(F.struct("r", *features)).alias("center")).collect()}
    rep = f"struct<r: double, pid: {pid}, core: double, {_coordinates(features)}>"
    cells = _constant([r.asDict(recursive=True) | {f: pivot[r["cell"]][f] for f in features} for r in rows],
                      f"cell: int, radius: double, core: double, first: {pid}, last: {pid}, lo: {rep}, hi: {rep}, {_coordinates(features)}")

    def edge(to_pid: Column, to_comp: Column, to_core: Column, to: Sequence[Column]) -> Column:
        return F.struct(F.greatest(distance(own, to), F.col("core"), to_core).alias("w"),
                        F.least("pid", to_pid).alias("a"), F.greatest("pid", to_pid).alias("b"), to_comp.alias("other"))

    def to_rep(c: Column, end: str, comp: str) -> Column:
        return F.when(c[comp] != F.col("comp"), edge(c[end]["pid"], c[comp], c[end]["core"], [c[end][f] for f in features]))

    start = F.array_min(F.transform(cells, lambda c: F.array_min(F.array(to_rep(c, "lo", "first"), to_rep(c, "hi", "last")))))
    known = cut_lineage(placed.select("comp", start.alias("e")).groupBy("comp").agg(F.min("e").alias("e")).where("e is not null"))
    bound = known.select("comp", F.col("e.w").alias("bound"))
    asked = placed.join(broadcast_if_bounded(bound), "comp")

    def may_hold(c: Column) -> Column:
        low = F.greatest(F.col("core"), c["core"], distance(own, [c[f] for f in features]) - c["radius"])
        return ((c["first"] != F.col("comp")) | (c["last"] != F.col("comp"))) & (low <= F.col("bound") * (1 + 1e-9))

    asked = asked.select("pid", "comp", "core", "bound", *features, F.explode(F.filter(cells, may_hold)).alias("c")).select(
        "pid", "comp", "core", "bound", *features, F.col("c.cell").alias("cell"),
        distance(own, [F.col(f"c.{f}") for f in features]).alias("d"))
    other = placed.select("cell", "r", F.col("pid").alias("tid"), F.col("comp").alias("tcomp"), F.col("core").alias("tcore"),
                          *[F.col(f).alias(f"t_{f}") for f in features])
    pairs = asked.join(other, "cell").where("comp != tcomp").where(
        (F.abs(F.col("d") - F.col("r")) <= F.col("bound") * (1 + 1e-9)) & (F.col("tcore") <= F.col("bound")))
    found = pairs.select("comp", edge(F.col("tid"), F.col("tcomp"), F.col("tcore"), [F.col(f"t_{f}") for f in features]).alias("e"))
    return found.unionByName(known).groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.other", "e.a", "e.b", "e.w")
