"""Connected components of a graph in tables, by alternating large and small stars; no component is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: longs, a != b); root is the least node of its component.

    A large star links each node's greater neighbours to its least neighbour, a small star its lesser ones; rows
    never outnumber the edges and each round halves long paths. Minima are pre-aggregated before the shuffle and
    joins on a hot node are split by adaptive execution. The rounds end once every node has one link, to a node that
    has none of its own. Without edges: no rows.
    """
    now = table(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if ends.filter("up > 1 or (up = 1 and down > 0)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, table(moved.union(low).distinct(), "stars")
        drop(before)
