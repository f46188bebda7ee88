"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long: the smallest node reachable) for each node
    of ``edges`` (a long, b long).

    Alternates large-star and small-star steps (each a grouped minimum and a
    join, so no node's neighbours are gathered in one place) until all edges
    lead to the smallest node. Loops, repeated edges, both directions and an
    empty table are allowed; rows with a null are ignored.
    """
    def grouped_minimum(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    # (u, v) with v < u always holds between the steps
    pairs = stored(pairs, "cc")
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(grouped_minimum(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        large = large.distinct()
        lows = grouped_minimum(large)
        small = (large.join(lows, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).distinct())
        small = stored(small, "cc")
        # a star forest: no node is both a member and a centre
        if small.select(F.col("v").alias("u")).join(small, "u", "left_semi").isEmpty() and \
                small.groupBy("u").count().filter("count > 1").isEmpty():
            pairs = small
            break
        pairs = small
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
