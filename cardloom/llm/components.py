"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.session import discard_tables, written, written_so_far


def to_minimum(edges: DataFrame) -> DataFrame:
    """edges with m: the least of a and its neighbours b. Hot nodes: minima are summed in each task, and the join is split."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("m")))
    return edges.join(least, "a")


def large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return to_minimum(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them; a > b in edges."""
    linked = to_minimum(edges)
    return linked.select(F.col("a"), F.col("m").alias("b")).union(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node and component, the least node it can reach, for every node of the edges.

    Rounds end when a round changes no edge; each writes its edges, so a lost executor costs one
    round. Only a count and a checksum of the edges go to the driver. Nodes are longs; null ends
    and loops are ignored. No edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    before = written_so_far()
    now = written(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == mark:
            break
        mark = state
        now = written(small_star(written(large_star(now).distinct())).distinct())
        discard_tables(now, before=before)  # of a round only its edges are needed
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
