"""Density clustering (K02 re-aimed) on planar coordinates.

HDBSCAN's building blocks expressed as Spark jobs:

1. core distance = distance to the ``min_samples``-th neighbour (exact kNN from ``neighbors.knn_join``; the point itself
   counts as the first neighbour, as in HDBSCAN);
2. the hierarchy is cut at ``epsilon``: points whose core distance is at most ε are dense, and dense points at most ε
   apart are linked (mutual reachability ≤ ε).  Links come from a grid of cells of edge ε/√2: all points of a cell are
   within ε, so one link each to the cell's first point is enough; between neighbouring cells one link per pair of
   cells is kept;
3. connected components by star contraction (``components.py``), without a cap on rounds;
4. components with ≥ ``min_cluster_size`` members are clusters, the rest is noise (-1).

This is the DBSCAN* cut of the HDBSCAN hierarchy at one ε, not the excess-of-mass selection across all ε;
``membership`` = core_min / core within the cluster and ``outlier_score`` = 1 - ε_cluster / core are reported as
approximations.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import grouped_quantiles
from tessera.operators.components import connected_components as components
from tessera.operators.neighbors import knn_join
from tessera.session import cut_lineage, spread

SPREAD = 2000  # a task's places that are compared with those of the cells about them


def core_distances(points: DataFrame, min_samples: int) -> DataFrame:
    """(pid, core): distance to the (min_samples - 1)-th other point (the point itself counts first)."""
    k = max(min_samples - 1, 1)
    nn = knn_join(points, points.withColumnRenamed("pid", "tid"), k, exclude_self=True)
    return nn.groupBy("pid").agg(F.max("dist").alias("core"))


def range_links(points: DataFrame, epsilon: float) -> DataFrame:
    """(src, dst) whose components are those of all pairs of (pid, x, y) at most ``epsilon`` apart."""
    if epsilon <= 0:  # equal places only
        w = Window.partitionBy("x", "y")
        return points.select(F.col("pid").alias("src"), F.min("pid").over(w).alias("dst")).where("src != dst")
    edge = epsilon / math.sqrt(2.0)
    cells = points.withColumn("cx", F.floor(F.col("x") / edge)).withColumn("cy", F.floor(F.col("y") / edge))
    first = cells.groupBy("cx", "cy").agg(F.min("pid").alias("lead"))
    cells = cut_lineage(cells.join(first, ["cx", "cy"]))
    inside = cells.where("pid != lead").select(F.col("pid").alias("src"), F.col("lead").alias("dst"))
    reach = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in reach])
    places = cut_lineage(cells.select("x", "y", "lead", "cx", "cy").distinct())
    probe = spread(places, "cx", "cy", rows=SPREAD).select("x", "y", "lead", F.explode(steps).alias("s"), "cx", "cy").select(
        "x", "y", "lead", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), "s")

    def gap(c: str, step: str) -> Column:
        """How far a place is from the nearer side of the other cell, a little less for rounding."""
        near, far = F.col(f"c{c}") * edge - F.col(c), F.col(c) - (F.col(f"c{c}") + 1) * edge
        off = F.when(F.col(step) > 0, near).when(F.col(step) < 0, far).otherwise(F.lit(0.0))
        return F.greatest(off - (F.abs(c) + edge) * 1e-12, F.lit(0.0))

    # only places that reach the other cell at all are compared with what it holds
    probe = probe.where(F.pow(gap("x", "s.i"), 2) + F.pow(gap("y", "s.j"), 2) <= epsilon * epsilon * (1 + 1e-9)).drop("s")
    other = places.select("cx", "cy", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("lead").alias("other"))
    near = probe.join(other, ["cx", "cy"]).where(
        F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2) <= epsilon * epsilon)
    across = near.select(F.col("lead").alias("src"), F.col("other").alias("dst")).distinct()
    return inside.unionByName(across)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, component) of every node; component = smallest pid reachable over (src, dst)."""
    parts = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.select("pid").join(parts.withColumnRenamed("node", "pid"), "pid", "left").select(
        "pid", F.coalesce("component", "pid").alias("component"))


def _cut(pts: DataFrame, core: DataFrame, epsilon: float) -> DataFrame:
    """(pid, component, size) of the dense points at one ε."""
    dense = cut_lineage(pts.join(core.where(F.col("core") <= epsilon).select("pid"), "pid", "left_semi"))
    comp = connected_components(dense, range_links(dense, epsilon))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return cut_lineage(comp.join(sizes, "component"))


def _labelled(pts: DataFrame, comp: DataFrame, min_cluster_size: int) -> DataFrame:
    """(pid, cluster): components of the size numbered in order, the rest -1."""
    big = comp.where(F.col("size") >= min_cluster_size)
    # at most n / min_cluster_size of them
    ranked = big.select("component").distinct().withColumn("cluster", F.dense_rank().over(Window.orderBy("component")) - 1)
    lab = big.join(ranked, "component").select("pid", "cluster")
    return pts.select("pid").join(lab, "pid", "left").withColumn(
        "cluster", F.coalesce(F.col("cluster"), F.lit(-1)).cast("int"))


def default_epsilon(core: DataFrame) -> float:
    """Three times the median core distance: the scale of the dense regions."""
    return 3.0 * (grouped_quantiles(core, [], "core", {"median": 0.5}).first()["median"] or 0.0)


def density_clusters(points: DataFrame, min_cluster_size: int = 5, min_samples: int = 3,
                     epsilon: float | None = None) -> DataFrame:
    """(pid, cluster, membership, outlier_score)."""
    pts = cut_lineage(points.select("pid", "x", "y"))
    core = cut_lineage(core_distances(pts, min_samples))
    eps = default_epsilon(core) if epsilon is None else epsilon
    out = _labelled(pts, _cut(pts, core, eps), min_cluster_size).join(core, "pid", "left")
    cmin = out.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.min("core").alias("cmin"))
    return (out.join(cmin, "cluster", "left")
            .withColumn("membership", F.when(F.col("cluster") >= 0, F.coalesce(
                F.try_divide(F.col("cmin"), F.col("core")), F.lit(1.0))).otherwise(0.0))
            .withColumn("outlier_score", F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(
                F.lit(float(eps)), F.col("core"))), F.lit(0.0)))
            .select("pid", "cluster", "membership", "outlier_score"))


def density_stability(points: DataFrame, min_cluster_size: int = 5, min_samples: int = 3, n_bootstrap: int = 10,
                      frac: float = 0.8, seed: int = 42) -> float:
    """K07 for density clustering: 1 - popstd / max(mean, 1) of the cluster counts on bootstrap resamples."""
    pts = cut_lineage(points.select("x", "y"))

    def clusters(i: int) -> int:
        drawn = pts.sample(withReplacement=True, fraction=frac, seed=seed + i).select(
            F.monotonically_increasing_id().alias("pid"), "x", "y")
        labels = density_clusters(drawn, min_cluster_size, min_samples)
        return labels.where("cluster >= 0").select(F.count_distinct("cluster")).first()[0]

    with ThreadPoolExecutor(max_workers=5) as pool:  # each resample is a chain of short jobs
        counts = list(pool.map(clusters, range(n_bootstrap)))
    mean = sum(counts) / len(counts)
    std = (sum((c - mean) ** 2 for c in counts) / len(counts)) ** 0.5
    return 1 - std / max(mean, 1.0)


# The reference's tuning grid.
TUNING_GRID = {"min_cluster_size": [50, 100, 150], "min_samples": [25, 50, 75],
               "cluster_selection_epsilon": [0.0, 0.1, 0.2]}


def tune_density(points: DataFrame, grid: dict | None = None) -> DataFrame:
    """Every grid point's clusters, outliers and non-noise silhouette
    (squared Euclidean); ``best`` marks the highest silhouette among
    settings with ≥ 2 clusters.  One kNN join (the largest k) serves every
    min_samples value, one cut every min_cluster_size; each ε is used as given."""
    from tessera.operators.metrics import silhouette_sq
    from tessera.operators.prep import to_long
    grid = grid or TUNING_GRID
    spark = points.sparkSession
    pts = cut_lineage(points.select("pid", "x", "y"))
    most = max(max(grid["min_samples"]) - 1, 1)
    nn = cut_lineage(knn_join(pts, pts.withColumnRenamed("pid", "tid"), most, exclude_self=True))
    long = to_long(pts, "pid", ["x", "y"])
    rows = []
    for ms in grid["min_samples"]:
        core = cut_lineage(nn.where(F.col("rank") <= max(ms - 1, 1)).groupBy("pid").agg(F.max("dist").alias("core")))
        for eps in grid["cluster_selection_epsilon"]:
            comp = _cut(pts, core, float(eps))
            for mcs in grid["min_cluster_size"]:
                lab = _labelled(pts, comp, mcs)
                st = lab.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"),
                             F.count_if(F.col("cluster") == -1).alias("noise")).first()
                sil = silhouette_sq(long, lab, "pid").first()[0] if st["k"] >= 2 else None
                rows.append((mcs, ms, float(eps), int(st["k"]), int(st["noise"]), sil))
    rows.sort(key=lambda r: r[:3])
    valid = [r for r in rows if r[5] is not None]
    best = max(valid, key=lambda r: r[5]) if valid else None
    return spark.createDataFrame(
        [(*r, r == best) for r in rows],
        "min_cluster_size int, min_samples int, cluster_selection_epsilon double, n_clusters int, "
        "n_outliers int, silhouette double, best boolean")
