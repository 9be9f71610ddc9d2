"""Exact k-nearest-neighbour join on planar coordinates.

Targets at one place are one place with its least ids, so a crowd on one spot weighs as much as a single point.  Distinct places
form a quadtree whose cells split while they hold more than ``LEAF`` places, at any scale, so a crowded corner is
split as finely as it needs.  Queries walk down the tree side by side, two levels a round: as soon as some cells surely hold
enough places within a distance, cells farther away are dropped.  No task ever holds more than a query's few cells, and no
pairs are made beyond the places of the cells that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import broadcast_if_bounded, cut_lineage, spread

LEAF = 32  # places of a cell that is not split
STEP = 2  # levels of a round
SPREAD = 5000  # a task's queries and cells, each of which makes up to ``LEAF`` pairs
DEEPEST = 48  # levels; distinct places that no cell of 2^-48 of the extent tells apart stay together
_BOX = ["x0", "x1", "y0", "y1"]


def _finite(*names: str) -> Column:
    a, b = (F.abs(F.col(c)) < F.lit(float("inf")) for c in names)
    return a & b


def _tree(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, cx, cy, up, ux, uy, n, box), the cells in use with their parent, where ``n`` places lie in the box; and
    (tx, ty, cell), the unsplit cell of each place."""
    row = places.agg(F.min("tx").alias("x"), F.min("ty").alias("y"),
                     F.greatest(F.max("tx") - F.min("tx"), F.max("ty") - F.min("ty")).alias("side")).first()
    x, y, side = float(row["x"] or 0.0), float(row["y"] or 0.0), float(row["side"] or 0.0) or 1.0
    top = 1 << DEEPEST

    def step(c: str, low: float) -> Column:
        return F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(side) * F.lit(float(top))), F.lit(top - 1)).cast("long")

    at = places.select("tx", "ty", step("tx", x).alias("ix"), step("ty", y).alias("iy"))
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(1 << (DEEPEST - d)).cast("long").alias("w"))
                                 for d in range(0, DEEPEST + 1, STEP)]))
    at = at.select("*", levels.alias("l")).select(
        "tx", "ty", "ix", "iy", "l.depth", F.expr("ix div l.w").alias("cx"), F.expr("iy div l.w").alias("cy"))
    cells = cut_lineage(at.groupBy("depth", "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"), F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"),
        F.max("ty").alias("y1")))
    wide = 1 << STEP
    child = cells.select("*", (F.col("depth") - STEP).alias("up"), F.expr(f"cx div {wide}").alias("ux"), F.expr(f"cy div {wide}").alias("uy"))
    split = cells.where(F.col("n") > LEAF).select(
        F.col("depth").alias("up"), F.col("cx").alias("ux"), F.col("cy").alias("uy"))
    tree = child.join(split, ["up", "ux", "uy"], "left_semi").unionByName(child.where("depth = 0"))
    # a cell whose places are all in one cell below is that cell: a crowd is reached in one round, however small it is
    here = F.struct("depth", "cx", "cy")
    tree = cut_lineage(tree.groupBy("n", *_BOX).agg(F.max(here).alias("low"), F.min(F.struct("up", "ux", "uy")).alias("top"))
                       .select("low.*", "top.*", "n", *_BOX))
    ends = tree.where((F.col("n") <= LEAF) | (F.col("depth") == DEEPEST)).select("depth", "cx", "cy")
    homes = at.join(ends, ["depth", "cx", "cy"]).select("tx", "ty", F.struct("depth", "cx", "cy").alias("cell"))
    return tree, homes


def _near_cells(queries: DataFrame, tree: DataFrame, need: int) -> DataFrame:
    """(px, py, cell, box): per query the unsplit cells that may hold one of its ``need`` nearest."""
    cell = F.struct("depth", "cx", "cy")
    nodes = tree.select(cell.alias("cell"), F.struct(F.col("up").alias("depth"), F.col("ux").alias("cx"),
                                                                F.col("uy").alias("cy")).alias("parent"),
                                    "n", *_BOX, ((F.col("n") > LEAF) & (F.col("depth") < DEEPEST)).alias("inner"))
    nodes = nodes.persist()
    below = broadcast_if_bounded(nodes)
    own = Window.partitionBy("px", "py").orderBy("most").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    side = {c: (F.greatest(F.col(f"{c}0") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"{c}1"), F.lit(0.0)),
                F.greatest(F.col(f"{c}1") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"{c}0"))) for c in "xy"}
    least, most = (F.sqrt(side["x"][i] * side["x"][i] + side["y"][i] * side["y"][i]) for i in (0, 1))
    parts = ["px", "py", "cell", "n", "inner", *_BOX]

    def closest(found: DataFrame) -> DataFrame:
        # cells that end within a distance and hold enough places set the bound; a little more is kept for rounding
        reached = found.withColumn("most", most).withColumn("held", F.sum("n").over(own))
        bound = F.min(F.when(F.col("held") >= need, F.col("most"))).over(Window.partitionBy("px", "py")) * (1 + 1e-12)
        kept = reached.withColumn("bound", bound).where(F.col("bound").isNull() | (least <= F.col("bound")))
        return cut_lineage(kept.select(*parts, "bound"))

    root = nodes.where("parent.depth < 0").select(F.struct("cell", "n", "inner", *_BOX)).scalar()
    front = queries.select("px", "py", root.alias("r")).select("px", "py", "r.*").withColumn("bound", F.lit(None).cast("double"))
    front = front.select(*parts, "bound")
    while front.where("inner").limit(1).count():
        opened = front.where("inner").select("px", "py", F.col("cell").alias("parent"), "bound").join(below, "parent")
        opened = opened.where(F.col("bound").isNull() | (least <= F.col("bound"))).select(*parts)
        front = closest(front.where("NOT inner").select(*parts).unionByName(opened))
    nodes.unpersist()
    return front.select("px", "py", "cell")


def knn_join(points: DataFrame, targets: DataFrame, k: int, *, exclude_self: bool = False) -> DataFrame:
    """For each point (pid, x, y) the k nearest targets (tid, x, y).

    Returns (pid, tid, dist, rank) with rank 1..k ordered by (dist, tid);
    fewer than k rows only when fewer targets exist.  ``exclude_self``
    drops pairs with pid == tid (self join).  Rows without a finite coordinate find nothing and are not found.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    need = k + 1 if exclude_self else k
    here = Window.partitionBy("tx", "ty").orderBy("tid")
    # each place keeps its least ids only; Spark limits the groups before it shuffles them
    t = cut_lineage(targets.select("tid", (F.col("x").cast("double") + 0.0).alias("tx"), (F.col("y").cast("double") + 0.0).alias("ty"))
                    .where(_finite("tx", "ty"))
                    .withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= need))
    p = points.select("pid", (F.col("x").cast("double") + 0.0).alias("px"), (F.col("y").cast("double") + 0.0).alias("py")).where(
        _finite("px", "py"))
    places = t.where("_n = 1").select("tx", "ty")
    if places.isEmpty():
        kinds = [d.schema[c].dataType.simpleString() for d, c in ((points, "pid"), (targets, "tid"))]
        return points.sparkSession.createDataFrame([], f"pid {kinds[0]}, tid {kinds[1]}, dist double, rank int")
    tree, homes = _tree(places)
    cells = _near_cells(cut_lineage(p.select("px", "py").distinct()), tree, need)
    filed = t.join(homes, ["tx", "ty"])
    dist = F.sqrt(F.pow(F.col("tx") - F.col("px"), 2) + F.pow(F.col("ty") - F.col("py"), 2))
    order = [F.col("dist"), F.col("tid")]
    top = (spread(cells, "px", "py", rows=SPREAD).join(filed, "cell").select("px", "py", "tid", dist.alias("dist"))
           .withColumn("rank", F.row_number().over(Window.partitionBy("px", "py").orderBy(*order)))
           .where(F.col("rank") <= need))
    out = p.join(top, ["px", "py"])
    if exclude_self:
        out = (out.where(F.col("tid") != F.col("pid"))
               .withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy(*order))).where(F.col("rank") <= k))
    return out.select("pid", "tid", "dist", F.col("rank").cast("int").alias("rank"))
