"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def stars(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of edges (a, b) that has a neighbour; root is the component's smallest node.

    Alternating large-star and small-star steps until only stars are left, each written to the shared folder; no
    step gathers a node's neighbours, only their minimum. Rounds grow with the logarithm of the longest chain. The
    result reads one written table, which ``discard`` removes.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, e = e, materialize(small.where("u <> v").distinct(), label)
        discard(old, large)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
    out._written_to = e._written_to
    return out


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every edge (u, v), v the smaller, leads to a center: no node has two edges down, or one down and one up."""
    one, none = F.lit(1), F.lit(0)
    ends = e.select(F.col("u").alias("n"), one.alias("down"), none.alias("up")).unionByName(e.select(F.col("v").alias("n"), none.alias("down"), one.alias("up")))
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()
