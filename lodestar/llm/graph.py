"""Connected components as DataFrame operations: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import BROADCAST_ROWS, cut, release


def _minima(pairs: DataFrame, few: bool, used: list[DataFrame]) -> DataFrame:
    """(u, m): the smallest v of each u, in a form for joins that never hold a hub's edges in one task.

    Few rows are broadcast. Many are cut off, so that both sides of the join are plain shuffles, whose
    large partitions are split; used gets them.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if few:
        return F.broadcast(least)
    used.append(cut(least))
    return used[-1]


def _round(edges: DataFrame, few: bool) -> DataFrame:
    """Every node links its larger neighbours, then its smaller ones and itself, to its smallest neighbour."""
    used: list[DataFrame] = []
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_minima(both, few, used), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
    if not few:
        large = cut(large)
        used.append(large)
    least = _minima(large, few, used)
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
    out = cut(small.distinct())
    release(edges, *used)
    return out


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself, or is such a neighbour."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low + high > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges: two columns of one type, in either direction; nulls and loops are ignored, repeats are
    harmless. Each round costs two aggregations with map-side minima and two joins, and no step holds
    a component or the edges of a hub in one task. A round never adds a component's edges and brings
    its nodes nearer to the smallest one, so the rounds end by themselves; their number grows with
    the logarithm of the diameter. Every round ends in a checkpoint, and the one before it is
    deleted. Nothing but one truth value a round reaches the driver.
    """
    a, b = edges.columns[:2]
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    few = now.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    while not _is_forest_of_stars(now):
        now = _round(now, few)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
