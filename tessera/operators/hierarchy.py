"""Hierarchical density clustering (K02): spanning tree, condensed tree, excess-of-mass selection.

1. Points of equal features are one place with a weight; core distances come from the exact neighbour join of
   ``metric.py`` over all features.
2. The minimum spanning tree of mutual-reachability distances grows by Boruvka rounds: each component's least edge to
   another (exact, ``metric.least_edges``), then star contraction joins the components.
3. The tree's edges are merged in ascending order, in blocks of a bounded number of edges whose components are already
   contracted, so a task holds one block.  All edges of one length merge at once: the result doesn't depend on
   which of several least trees was found.  A component of ``min_cluster_size`` points is a cluster; where two or more
   meet, they end and a parent begins; smaller ones fall out of the cluster they meet.
4. A cluster is kept if its stability is at least what its parts hold, and none above it is kept; the root never is.
   ``epsilon`` then climbs from clusters born below that distance to the ancestor that was born above it.

``membership`` is the point's density when it left, relative to the densest that left its cluster; ``outlier_score`` is one
minus that, relative to the densest of the whole branch.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.metric import cells_of, core_distances, least_edges
from tessera.session import cut_lineage

# the merging step travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 200_000  # edges that one task merges
SHORTEST = 1e-12  # distances below count as this one (their inverse is the density)


def followed(steps: DataFrame) -> DataFrame:
    """(node, to) with ``to`` followed until it points at itself, by pointer doubling: rounds grow with the log of a path."""
    while True:
        ahead = steps.select(F.col("node").alias("to"), F.col("to").alias("far"))
        after = cut_lineage(steps.join(ahead, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.drop("moved")
        steps = after.drop("moved")


def spanning_tree(places: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, w): a least spanning tree of the places (pid, weight, core, features) by mutual reachability."""
    placed = cut_lineage(cells_of(places, features).withColumn("comp", F.col("pid")))
    tree = None
    while True:
        edges = cut_lineage(least_edges(placed, features))
        if not edges.limit(1).count():
            break
        new = edges.select("a", "b", "w").distinct()
        tree = new if tree is None else tree.unionByName(new)
        # every component points at the one its edge leads to; of two that point at each other the lesser is the root
        back = edges.select(F.col("comp").alias("other"), F.col("other").alias("back"))
        steps = edges.select("comp", "other").join(back, "other").select(F.col("comp").alias("node"), F.when(
            (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("to"))
        parts = followed(steps).withColumnsRenamed({"node": "comp", "to": "next"})
        placed = cut_lineage(placed.join(parts, "comp", "left").withColumn("comp", F.coalesce("next", "comp")).drop("next"))
    if tree is None:
        kind = places.schema["pid"].dataType.simpleString()
        return places.sparkSession.createDataFrame([], f"a {kind}, b {kind}, w double")
    return cut_lineage(tree)


class _Merging:
    """Components of one block of edges, merged in ascending order of length."""

    def __init__(self, min_size: int, first_id: int):
        self.min_size, self.next_id = min_size, first_id
        self.parent: dict = {}
        self.state: dict = {}  # root -> [size, cluster, mass, kids, densest, top]
        self.loose: dict = {}  # root -> components of its points that are in no cluster yet
        self.fallen: list = []  # (component, cluster, density)
        self.closed: list = []  # (cluster, parent, size, birth, stability, kids, densest, top)

    def add(self, comp, state: list) -> None:
        if comp not in self.parent:
            self.parent[comp], self.state[comp] = comp, state
            self.loose[comp] = [comp] if state[1] is None else []

    def root(self, comp):
        while self.parent[comp] != comp:
            self.parent[comp] = comp = self.parent[self.parent[comp]]
        return comp

    def merge(self, edges: list[tuple], density: float) -> None:
        """All edges of one length."""
        met: dict = {}
        for u, v in edges:
            a, b = self.root(u), self.root(v)
            if a != b:
                if len(met.get(a, ())) < len(met.get(b, ())):
                    a, b = b, a
                met.setdefault(a, [a]).extend(met.pop(b, [b]))
                self.parent[b] = a
        for root, parts in met.items():
            states = [self.state.pop(p) for p in parts]
            loose = [c for p in parts for c in self.loose.pop(p)]
            big = [s for s in states if s[1] is not None]
            size = sum(s[0] for s in states)
            if len(big) == 1:
                now = big[0]
                fallen = size - now[0]
                now[0], now[2], now[4], now[5] = size, now[2] + fallen * density, max(now[4], density), max(now[5], density)
            elif len(big) > 1 or size >= self.min_size:
                now = [size, self.next_id, size * density, 0.0, density, density]
                self.next_id += 1
                for s in big:
                    stability = s[2] - s[0] * density
                    self.closed.append((s[1], now[1], s[0], density, stability, *s[3:]))
                    now[3] += max(stability, s[3])
                    now[4] = max(now[4], s[4])
            else:
                self.state[root], self.loose[root] = [size, None, 0.0, 0.0, 0.0, 0.0], loose
                continue
            self.fallen += [(c, now[1], density) for c in loose]
            self.state[root], self.loose[root] = now, []


def _merged(block: DataFrame, kind: str, min_size: int, first_id: int) -> DataFrame:
    """One block of edges (w, u, v and both states): rows of what became of components, of clusters and of loose points.

    ``what``: comp (comp is now ``into``), state (of the component ``comp``), closed (a cluster and its parent), fallen (the
    points of ``comp`` left ``cluster`` at density ``mass``).
    """
    name_type = to_arrow_type(block.schema["u"].dataType)
    names = ["what", "comp", "into", "size", "cluster", "parent", "mass", "kids", "densest", "top", "birth"]
    kinds = ["string", kind, kind, "long", "long", "long", *["double"] * 5]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: r["w"])
        work = _Merging(min_size, first_id)
        for r in rows:
            for end in "uv":
                work.add(r[end], [r[f"{end}_{n}"] for n in ("size", "cluster", "mass", "kids", "densest", "top")])
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to]["w"] == rows[at]["w"]:
                to += 1
            work.merge([(r["u"], r["v"]) for r in rows[at:to]], 1 / max(rows[at]["w"], SHORTEST))
            at = to
        out = [("comp", c, work.root(c), *[None] * 8) for c in work.parent]
        out += [("state", c, None, s[0], s[1], None, *s[2:], None) for c, s in work.state.items()]
        out += [("closed", None, None, size, c, up, stability, kids, densest, top, birth)
                for c, up, size, birth, stability, kids, densest, top in work.closed]
        out += [("fallen", c, None, None, cluster, None, density, None, None, None, None) for c, cluster, density in work.fallen]
        types = [pa.string(), name_type, name_type, *[pa.int64()] * 3, *[pa.float64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return block.coalesce(1).mapInArrow(merge, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def condensed_tree(places: DataFrame, tree: DataFrame, min_cluster_size: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, size, birth, stability, kids, densest, top; the root has no parent) and the places'
    (pid, cluster, density): which cluster they left, and when.  Places that never met a cluster are not listed."""
    spark = places.sparkSession
    kind = places.schema["pid"].dataType.simpleString()
    n = tree.count()
    cuts = [-math.inf, *sorted({float(q) for q in tree.approxQuantile(
        "w", [k / math.ceil(n / block) for k in range(1, math.ceil(n / block))], 0.001)}), math.inf] if n > block else [-math.inf, math.inf]
    member = places.select("pid", F.col("pid").alias("comp"))
    # a place of enough points is a cluster by itself, from the distance on at which its points meet
    names = ["comp", "size", "cluster", "mass", "kids", "densest", "top"]
    dense = F.col("weight") >= min_cluster_size
    peak = 1 / F.greatest("core", F.lit(SHORTEST))
    own = places.where(dense).select(F.col("pid").alias("comp"), F.col("weight").alias("size"),
                                     (-1 - F.monotonically_increasing_id()).alias("cluster"),
                                     (F.col("weight") * peak).alias("mass"), F.lit(0.0).alias("kids"),
                                     peak.alias("densest"), peak.alias("top"))
    small = places.where(~dense).select(F.col("pid").alias("comp"), F.col("weight").alias("size"), F.lit(None).cast("long").alias("cluster"),
                                        *[F.lit(0.0).alias(c) for c in names[3:]])
    state = cut_lineage(own.unionByName(small))
    left = [state.where("cluster is not null").select(F.col("comp").alias("pid"), "cluster", F.col("top").alias("density"))]
    closed = []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        edges = tree.where((F.col("w") > low) & (F.col("w") <= high)).select("a", "b", "w")
        for end, name in (("a", "u"), ("b", "v")):
            edges = edges.join(member.withColumnsRenamed({"pid": end, "comp": name}), end)
        for end in "uv":
            edges = edges.join(state.withColumnsRenamed({c: end if c == "comp" else f"{end}_{c}" for c in names}), end)
        out = cut_lineage(_merged(edges.drop("a", "b"), kind, min_cluster_size, 1 + i * (n + 2)))
        fallen = out.where("what = 'fallen'").select("comp", "cluster", F.col("mass").alias("density"))
        left.append(cut_lineage(member.join(fallen, "comp").select("pid", "cluster", "density")))
        closed.append(out.where("what = 'closed'").select("cluster", "parent", "size", "birth", F.col("mass").alias("stability"), "kids", "densest", "top"))
        into = out.where("what = 'comp'").select("comp", "into")
        if i + 2 < len(cuts):
            member = cut_lineage(member.join(into, "comp", "left").select("pid", F.coalesce("into", "comp").alias("comp")))
        state = cut_lineage(state.join(into.select("comp"), "comp", "left_anti").unionByName(
            out.where("what = 'state'").select(*names)))
    none = F.lit(None)
    closed.append(state.where("cluster is not null").select(
        "cluster", none.cast("long").alias("parent"), "size", F.lit(0.0).alias("birth"), F.col("mass").alias("stability"), "kids", "densest", "top"))
    whole, points = closed[0], left[0]
    for more in closed[1:]:
        whole = whole.unionByName(more)
    for more in left[1:]:
        points = points.unionByName(more)
    return cut_lineage(whole), cut_lineage(points)


def selected(clusters: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(cluster, chosen): the kept cluster that each cluster is part of, if any."""
    steps = clusters.select("cluster", F.col("parent").alias("up"),
                            F.when(F.col("parent").isNotNull() & (F.col("stability") >= F.col("kids")), F.col("cluster")).alias("best"))
    steps = cut_lineage(steps)
    while steps.where("up is not null").limit(1).count():
        ahead = steps.select(F.col("cluster").alias("up"), F.col("up").alias("far"), F.col("best").alias("above"))
        moved = steps.where("up is not null").join(ahead, "up").select("cluster", F.col("far").alias("up"), F.coalesce("above", "best").alias("best"))
        steps = cut_lineage(moved.unionByName(steps.where("up is null")))
    chosen = steps.where("best is not null").select("cluster", F.col("best").alias("chosen"))
    if epsilon <= 0:
        return chosen
    root = clusters.where("parent is null").select(F.col("cluster").alias("root"))
    born = F.try_divide(F.lit(1.0), F.col("birth"))  # the distance at which a cluster parts from its parent
    climb = clusters.join(root, F.col("parent") == F.col("root"), "left").select(F.col("cluster").alias("node"), F.when(
        F.col("parent").isNotNull() & F.col("root").isNull() & (born <= epsilon), F.col("parent")).otherwise(F.col("cluster")).alias("to"))
    climb = followed(climb).withColumnsRenamed({"node": "chosen", "to": "climbed"})
    low = clusters.select(F.col("cluster").alias("chosen"), (born < epsilon).alias("low"))
    return chosen.join(climb, "chosen").join(low, "chosen").select(
        "cluster", F.when(F.col("low"), F.col("climbed")).otherwise(F.col("chosen")).alias("chosen"))


def labelled(points: DataFrame, clusters: DataFrame, left: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(pid, cluster, membership, outlier_score) of the places; clusters are numbered by their smallest pid, noise is -1."""
    branch = clusters.select("cluster", "densest").join(selected(clusters, epsilon), "cluster", "left")
    top = clusters.select(F.col("cluster").alias("chosen"), "top")
    of = left.join(branch, "cluster").join(top, "chosen", "left")
    numbers = of.where("chosen is not null").groupBy("chosen").agg(F.min("pid").alias("least")).select(
        "chosen", (F.row_number().over(Window.orderBy("least")) - 1).alias("number"))  # a row for each cluster
    of = of.join(numbers, "chosen", "left").select(
        "pid", F.coalesce("number", F.lit(-1)).cast("int").alias("cluster"),
        F.when(F.col("number").isNull(), 0.0).otherwise(F.least(F.col("density") / F.col("top"), F.lit(1.0))).alias("membership"),
        (1 - F.col("density") / F.col("densest")).alias("outlier_score"))
    return points.select("pid").join(of, "pid", "left").select(
        "pid", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("membership", F.lit(0.0)).alias("membership"),
        F.coalesce("outlier_score", F.lit(0.0)).alias("outlier_score"))


def places_of(points: DataFrame, features: Sequence[str]) -> DataFrame:
    """(pid, weight, features): one row for points of equal features, named by the smallest pid."""
    return cut_lineage(points.groupBy(*[F.col(f).cast("double").alias(f) for f in features]).agg(
        F.min("pid").alias("pid"), F.count(F.lit(1)).alias("weight")).select("pid", "weight", *features))


def hierarchical_clusters(points: DataFrame, features: Sequence[str], min_cluster_size: int = 5, min_samples: int = 3,
                          epsilon: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(pid, cluster, membership, outlier_score) of every point (pid and the features, all finite)."""
    places = cut_lineage(core_distances(places_of(points, features), features, min_samples))
    tree = spanning_tree(places, features)
    clusters, left = condensed_tree(places, tree, min_cluster_size, block)
    return spread(points, features, places, labelled(places, clusters, left, epsilon))


def spread(points: DataFrame, features: Sequence[str], places: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of places for their points."""
    of = places.join(labels, "pid").select(*features, "cluster", "membership", "outlier_score")
    return points.select("pid", *[F.col(f).cast("double").alias(f) for f in features]).join(of, list(features)).select(
        "pid", "cluster", "membership", "outlier_score")
