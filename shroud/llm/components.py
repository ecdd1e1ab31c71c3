"""Connected components over an edge table, by alternating star contraction.

Each round joins and aggregates edges by node (large star: hang every larger
neighbour of a node on the smallest one; small star: the same for smaller
neighbours), so no component is ever gathered in one task or on the driver.
A node with many neighbours only meets partial aggregates (``min``) and an
equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, discard, materialize

EDGES_PER_FILE = 200_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(e: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then each edge leads to its component's root."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` (any comparable type, no nulls) -> ``(node, root)``.

    ``root`` is the smallest node of the component. Only nodes on an edge
    between two different nodes appear. Repeated and reversed edges are
    harmless; an empty table gives an empty result. Every round is written to
    the shared checkpoint folder, which cuts the lineage.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "cc")
    while not _all_stars(e):
        before, e = e, materialize(_small_star(_large_star(e)), "cc", files=blocks_of(e.count(), EDGES_PER_FILE))
        discard(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
