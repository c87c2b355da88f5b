"""Merging tables without a table format: upserts, rollbacks, keep-old merges, dispositions and chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in order."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], replace: bool = True) -> DataFrame:
    """The next version of a table with action: added, updated, skipped or kept. Both sides have unique keys.

    With replace, a new row that differs takes the old one's place; else old rows stay.
    """
    o, n = old.select(*keys, F.struct(*values).alias("_old")), new.select(*keys, F.struct(*values).alias("_new"))
    both = o.join(n, keys, "full_outer")
    same = F.col("_old").eqNullSafe(F.col("_new"))
    changed = F.lit(replace) & ~same
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").when(changed, "updated").otherwise("skipped")
    row = F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & changed), F.col("_new")).otherwise(F.col("_old"))
    return both.withColumn("action", action).withColumn("_row", row).select(*keys, "_row.*", "action")


def merge_keep_old(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], maps: list[str] | None = None) -> DataFrame:
    """New values where there are any, else the old ones; maps are joined key by key, new over old."""
    maps = maps or []
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    kept = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values]
    empty = F.create_map().cast("map<string,string>")

    def overlaid(name: str) -> Column:
        below, above = F.coalesce(F.col(f"o.{name}"), empty), F.coalesce(F.col(f"n.{name}"), empty)
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above).alias(name)

    joined = [overlaid(c) for c in maps]
    return both.select(*keys, *kept, *joined)


def roll_back(rows: DataFrame, batch: Column) -> DataFrame:
    """The rows that are not of the batch; rows without a batch stay."""
    return rows.filter(~F.coalesce(batch, F.lit(False)))


def dispose(rows: DataFrame, rules: list[tuple[Column, str]], key: list[str], *order: Column | str) -> DataFrame:
    """Each row with one disposition: the first rule it breaks, duplicate after the first good row of its key, else accepted."""
    error = None
    for condition, name in rules:
        error = F.when(condition, name) if error is None else error.when(condition, name)
    marked = rows.withColumn("_error", error)
    turn = F.row_number().over(Window.partitionBy(F.col("_error").isNotNull(), *key).orderBy(*order))
    return marked.withColumn("disposition", F.when(F.col("_error").isNotNull(), F.col("_error")).when(turn > 1, "duplicate").otherwise("accepted")).drop("_error")


def hash_chain(events: DataFrame, owner: str, order: list[str], payload: str) -> DataFrame:
    """The events with position and chain: each hash covers the one before it in its owner's log.

    A chain is a fold in order, so an owner's log is one stream through one task; it is read in
    batches and never held whole.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    dealt = events.repartition(owner).sortWithinPartitions(owner, *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, at = object(), "", 0
        for batch in batches:
            chain, places = [], []
            for name, text in zip(batch[owner], batch[payload], strict=True):
                if name != now:
                    now, last, at = name, "", 0
                last, at = hashlib.sha256(f"{last}|{'' if text is None else text}".encode()).hexdigest(), at + 1
                chain.append(last)
                places.append(at)
            yield batch.assign(position=places, chain=chain)

    return dealt.mapInPandas(fold, f"{fields}, position bigint, chain string")


def cascade(children: DataFrame, parents: DataFrame, key: str, revoked: Column) -> DataFrame:
    """Children with their status set to revoked where their parent is."""
    gone = parents.filter(revoked).select(key).distinct().withColumn("_gone", F.lit(True))
    return children.join(gone, key, "left").withColumn("status", F.when(F.col("_gone"), "revoked").otherwise(F.col("status"))).drop("_gone")
