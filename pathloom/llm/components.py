"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a long, b long) -> (node, component): the smallest node that each node
    reaches.  Nodes without an edge do not appear.

    Alternating large-star and small-star rounds: each hooks nodes to smaller neighbours,
    so the number of rounds grows with the logarithm of a component's size.  Every round is
    two aggregations and joins over at most as many edges as given, written to the shared
    folder, and one more aggregation that looks for a node whose edges are not those of a
    star; only whether there is one reaches the driver.  Nulls and self-edges are left out.
    """
    edges = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    edges = stored(edges.where("lo < hi").distinct(), f"{name}-0")
    for i in range(1, 200):
        ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # in a star a node has edges down only, or a single one up
        if not ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").take(1):
            break
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # small star: each node hooks its smaller neighbours, and itself, to the least of them
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hooked = down.join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        edges = stored(hooked.unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).where("lo < hi").distinct(), f"{name}-{i}")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
