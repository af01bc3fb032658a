"""Connected components of a table of links, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node which has a link; root is the smallest node
    reachable.

    Rounds of large and small stars: first every larger neighbour of a node,
    then every smaller one, is hung under the smallest.  The number of rounds
    grows with the logarithm of the longest path.  The smallest neighbours are
    an aggregate which combines before its shuffle, and written before they are
    joined back, so that adaptive execution can split the join at a star's
    centre.  Links stay in tables throughout; the driver sees one number a
    round.
    """
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.filter("u <> v").distinct())
        # After the large star every edge leads from a node to a smaller one.
        smallest = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # Done when each node hangs under one root and no root hangs itself.
        if after.groupBy("u").count().filter("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            edges = after
            break
        edges = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
