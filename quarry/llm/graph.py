"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dropped, rekeyed, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): the smallest node that each node of the edges reaches.

    Alternates large-star and small-star steps until the stars stop changing; every step is
    two aggregations by node with map-side minima, so a hub costs one row per partition. The
    neighbours of a hub are its own rows, never pairs of them. Round tables are written to the
    shared folder, so a lost executor costs one step.
    """
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    while True:
        # large star: every neighbour above a node goes to the smallest of its neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(rekeyed(least, "a"), "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: every node and its smaller neighbours go to the smallest of them
        large = written(large, "large")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(rekeyed(down, "b"), "b").select("m", F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        small = written(small, "small")
        more = small.join(links, ["a", "b"], "left_anti").limit(1).count() + links.join(small, ["a", "b"], "left_anti").limit(1).count()
        dropped(links, large)
        links = small
        if not more:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
