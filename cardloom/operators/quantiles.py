"""Exact quantiles of groups of any size, without gathering a group's values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.order import in_order
from cardloom.session import written

#: Rows of a group up to which one task takes them all; larger groups are dealt to many tasks.
GATHERED = 20_000


def by_group_size(rows: DataFrame, by: list[str], whole: Callable[[DataFrame], DataFrame], dealt: Callable[[DataFrame], DataFrame], most: int = GATHERED) -> DataFrame:
    """whole of the rows in groups of at most so many rows, and dealt of those in larger groups, if there are any.

    Both must give the same columns and see all rows of their groups. There are at most 1 / most as many
    larger groups as rows, so their names are broadcast. A group of nulls counts as one.
    """
    named = [F.col(c).alias(f"_by_{c}") for c in by]
    large = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*named))
    if large.isEmpty():
        return whole(rows)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return whole(rows.join(F.broadcast(large), same, "left_anti")).unionByName(dealt(rows.join(F.broadcast(large), same, "left_semi")))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, subsets: dict[str, Column], probs: dict[str, float]) -> DataFrame:
    """by, and for each subset its count s_n and the quantiles s_q of its values, interpolated between the two nearest ranks.

    A subset is a condition on rows; null values belong to none. Rows are put in order by group and value over ranges, so a group of a third
    of all rows is dealt to many tasks. A row's rank in each subset is the rows of the subset before it in its task and the
    counts of the tasks before; of every group only counts of tasks and the rows at the ranks asked for are brought together. Groups without values have no row.
    """
    flags = {s: F.coalesce(c & F.col(value).isNotNull(), F.lit(False)).cast("int") for s, c in subsets.items()}
    narrow = rows.select(*by, F.col(value).cast("double").alias("_v"), *[f.alias(f"_in_{s}") for s, f in flags.items()])
    some = F.lit(0)
    for s in subsets:
        some = some + F.col(f"_in_{s}")
    placed = in_order(narrow.filter(some > 0), [*map(F.col, by), F.col("_v")]).withColumn("_task", F.shiftright("_at", 33))

    runs = placed.groupBy(*by, "_task").agg(*[F.sum(f"_in_{s}").alias(f"_n_{s}") for s in subsets])
    earlier = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = [x for s in subsets for x in (F.coalesce(F.sum(f"_n_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}"), F.sum(f"_n_{s}").over(whole).alias(f"_t_{s}"))]
    totals = runs.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_task").alias("_of"), *sums)

    in_run = Window.partitionBy(*by, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumns({f"_r_{s}": F.coalesce(F.sum(f"_in_{s}").over(in_run), F.lit(0)) for s in subsets})
    same = F.col("_task") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = ranked.join(totals, same)
    picks = []
    for s in subsets:
        rank, n, inside = F.col(f"_b_{s}") + F.col(f"_r_{s}"), F.col(f"_t_{s}"), F.col(f"_in_{s}") == 1
        picks.append(F.coalesce(F.max(n), F.lit(0)).alias(f"{s}_n"))
        for q, p in probs.items():
            place = F.lit(p) * (n - 1)
            picks += [F.max(F.when(inside & (rank == F.floor(place)), F.col("_v"))).alias(f"_lo_{s}_{q}"), F.max(F.when(inside & (rank == F.ceil(place)), F.col("_v"))).alias(f"_hi_{s}_{q}")]
    found = joined.groupBy(*by).agg(*picks)
    out = []
    for s in subsets:
        n = F.col(f"{s}_n")
        out.append(n)
        for q, p in probs.items():
            place, low, high = F.lit(p) * (n - 1), F.col(f"_lo_{s}_{q}"), F.col(f"_hi_{s}_{q}")
            between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
            out.append(F.when(n > 0, F.when(F.ceil(place) == F.floor(place), low).otherwise(between)).alias(f"{s}_{q}"))
    return found.select(*by, *out)


def with_quantiles(rows: DataFrame, by: list[str], quantiles: DataFrame) -> DataFrame:
    """rows with their group's quantiles, null for groups that have none; a hot group's rows stay in many tasks."""
    named = quantiles.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(named, same, "left").drop(*[f"_of_{c}" for c in by])
