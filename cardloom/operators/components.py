"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.session import spread, written


def with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the least of a and its neighbours b. Minima are summed in each task first, and a hot node's join is split."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("m")))
    return edges.join(spread(least), "a")


def linked_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and group: the least id that each of the nodes can reach over the edges a, b; a node without edges stands alone.

    A large star links every larger neighbour of a node to its least neighbour, a small star a node and its smaller neighbours to the least of
    them. Both keep components and halve distances, so the rounds grow with the logarithm of the longest path, and the
    edges never grow. Ids are longs; null ends and loops are ignored. Each round is written; only a count
    and a checksum go to the driver.
    """
    now = written(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == mark:
            break
        mark = state
        both = now.union(now.select("b", "a"))
        large = written(with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = with_least(large)
        now = written(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")).distinct())
    return nodes.select("id").join(spread(now.select(F.col("a").alias("id"), F.col("b").alias("group"))), "id", "left").select("id", F.coalesce("group", "id").alias("group"))
