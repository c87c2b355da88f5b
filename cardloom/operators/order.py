"""Positions in a total order, pages and caps, without bringing all rows or one group's rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.session import spread, written


def in_order(rows: DataFrame, order: list[Column], at: str = "_at") -> DataFrame:
    """The rows, written, with a long column that rises along the order; rows that tie rise in any order.

    Rows are dealt by ranges of the order and of a number of their own, so rows that tie are dealt to many
    tasks too. A task's positions are consecutive, and tasks follow each other with gaps.
    """
    keys = [*order, F.col("_tie")]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ranged.drop("_tie").withColumn(at, F.monotonically_increasing_id()))


def numbered(placed: DataFrame, by: list[str], number: str, at: str = "_at") -> DataFrame:
    """Rows of in_order with their place 0, 1, 2, ... among those of the same by columns, without gaps.

    by may be empty, or the columns that the order begins with: then a group's rows in one task are
    consecutive. Only one count for each task and group is shuffled and put in order.
    """
    task = F.shiftright(at, 33)
    runs = placed.groupBy(*by, task.alias("_task")).agg(F.min(at).alias("_begin"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*by, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_begin")).alias("_shift"))
    left, right = placed.withColumn("_task", task), starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_task").alias("_in"), "_shift")
    same = F.col("_task") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return left.join(spread(right) if by else right, same).withColumn(number, F.col(at) + F.col("_shift")).drop("_task", "_in", "_shift", *[f"_by_{c}" for c in by])


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, number: str = "position") -> DataFrame:
    """The rows of one page, with their positions from offset on; order should be total.

    Each page costs one pass that puts all rows in order; no task holds the rows before the offset.
    """
    placed = numbered(in_order(rows, order), [], number)
    return placed.filter((F.col(number) >= offset) & (F.col(number) < offset + limit)).drop("_at")


def capped(rules: list[DataFrame], order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of rules, the first rule first and within a rule by order, at most so many in all; and each rule's rows before the cap.

    rules share their columns. Returns rows with rule (from 0) and position, and rule with found and shown.
    """
    every = None
    for at, rows in enumerate(rules):
        part = rows.withColumn("rule", F.lit(at))
        every = part if every is None else every.unionByName(part)
    placed = numbered(in_order(every, [F.col("rule"), *order]), [], "position")
    counts = placed.groupBy("rule").agg(F.count(F.lit(1)).alias("found"), F.sum((F.col("position") < most).cast("long")).alias("shown"))
    return placed.filter(F.col("position") < most).drop("_at"), counts
