"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_of


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any comparable type to (node, root): root is the smallest node reachable.

    Nodes without an edge don't appear; self loops and repeated edges are ignored; an empty table gives an empty table.
    Every step is a partially aggregated minimum by node and a join back, which adaptive execution splits at hot nodes.
    Rounds grow with the logarithm of the longest path. Each round is cut in the shared checkpoint folder, in as many
    partitions as there are edges for. The steps keep what is connected connected and let edges point downwards, so it is done
    when every node points to one node and none of these points further.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    parts = parts_of(edges.count())
    e = cut(edges.coalesce(parts).distinct().coalesce(parts))
    while not done(e):
        # large star: larger neighbours of a node hang under the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.unionByName(low.filter("m < a").select("a", F.col("m").alias("b")))
        # small star: smaller neighbours of a node and the node itself hang under the smallest of them
        big = big.filter("a <> b").coalesce(parts).distinct().coalesce(parts)
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        e = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut(e.filter("a <> b").coalesce(parts).distinct().coalesce(parts))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def done(e: DataFrame) -> bool:
    if e.join(e.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
        return False
    n = e.agg(F.count("*"), F.count_distinct("a")).first()
    return n[0] == n[1]
