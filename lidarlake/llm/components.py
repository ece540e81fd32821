"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is an aggregation and a join on a narrow, deduplicated edge table that is written to the
shared folder; the driver only learns whether all parts are stars yet. Stars around one node, however large, are
reduced by partial aggregation, and the join on it is one that adaptive execution splits.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.session import materialize


def _star(pairs, keep):
    """Replace each kept neighbour pair (u, v) by (v, smallest node around u)."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.where(keep).join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("w"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has either one smaller neighbour, that has none itself, or none."""
    ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("w").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes with an edge; ``edges``: (a, b), the component is its least node."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, "v > u").select("u", "v").where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())
