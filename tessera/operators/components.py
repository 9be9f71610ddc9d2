"""Connected components of a distributed edge table by alternating star contraction.

Each round hooks every neighbour of a node to the smallest node it knows: first the larger neighbours (large star),
then the smaller ones (small star).  Rounds go on until the edge set no longer changes; their number grows with the
logarithm of the longest path, and there is no cap.  Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hook neighbours of ``u`` to the smallest node of its neighbourhood; edges hold u > v."""
    both = edges
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    hooked = both.join(least.select("u", F.least("u", "m").alias("m")), "u")
    if larger:
        out = hooked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    ``edges`` has columns ``u`` and ``v`` of one orderable type; loops, repeats, nulls and either direction are
    allowed (a null end drops the edge).  ``keep`` materializes a round.
    """
    now = keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = keep(_stars(_stars(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
