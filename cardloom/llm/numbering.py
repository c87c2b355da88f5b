"""Gapless numbers within groups of any size, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.session import cut


def number_within(df: DataFrame, key: str, number: str) -> DataFrame:
    """Add a long column that counts 0, 1, 2, ... within each value of the non-null column key.

    Each task sorts its own rows by key, and the rows are written once. A value's rows in one task
    then have consecutive positions, so a row's number is its position, less the first one of its
    run, plus the rows of the value in earlier tasks. Only (task, key) counts are shuffled before
    the final join, so a value that holds most rows costs no more than any other.
    """
    placed = cut(df.sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    runs = placed.groupBy(task.alias("_task"), key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("_task", key, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_task", task).join(starts, ["_task", key])
    return joined.withColumn(number, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_task", "_first", "_before")
