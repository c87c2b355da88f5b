"""Override tables as versions with times of validity, rollbacks of batches, and inserts that ignore what a partial index holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def override_versions(upserts: DataFrame, rollbacks: DataFrame, key: str = "card_id") -> DataFrame:
    """The upserts with valid_from, valid_to (null while valid), ended_by, action and created_at.

    upserts: at (unique among both tables), key, batch and values; rollbacks: at, batch. A version holds until the next upsert of its key
    or the first later rollback of its batch; a rollback takes away only what is valid, so what an upsert replaced does not return. action is updated
    if the key had a valid version then, else added; created_at is the at of the first version since the key was last
    without one. Null keys are passed over, a null batch is never rolled back, and rollbacks of unknown batches do nothing.

    A batch's next rollback is found by sorting both by batch and at, so a batch of many rows meets no list of rollbacks.
    """
    known = upserts.filter(F.col(key).isNotNull())
    events = known.select("batch", "at", F.lit(0).alias("_kind")).unionByName(rollbacks.select("batch", "at", F.lit(1).alias("_kind"))).filter("batch IS NOT NULL")
    later = Window.partitionBy("batch").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    gone = events.withColumn("_gone", F.min(F.when(F.col("_kind") == 1, F.col("at"))).over(later)).filter("_kind = 0").select(F.col("at").alias("_at"), "_gone")
    in_turn = Window.partitionBy(key).orderBy("at")
    rows = known.join(gone, F.col("at") == F.col("_at"), "left").drop("_at").withColumn("_next", F.lead("at").over(in_turn))
    rows = rows.withColumn("valid_to", F.least("_next", "_gone")).withColumn("ended_by", F.when(F.col("_gone") <= F.coalesce("_next", "_gone"), "rollback").when(F.col("_next").isNotNull(), "upsert"))
    held = F.coalesce(F.lag("ended_by").over(in_turn) == "upsert", F.lit(False))
    rows = rows.withColumn("action", F.when(held, "updated").otherwise("added"))
    began = F.max(F.when(F.col("action") == "added", F.col("at"))).over(in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("created_at", began).withColumn("valid_from", F.col("at")).drop("_gone", "_next")


def valid_at(versions: DataFrame, at: Column | int) -> DataFrame:
    """The rows that held right after the change at; a state that a later rollback or upsert ended is restored so."""
    at = at if isinstance(at, Column) else F.lit(at)
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def override_audit(versions: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """at, type, batch, rows: each upsert that added or updated, and each rollback with the rows that it removed."""
    changes = versions.select("at", F.concat(F.lit("override_"), "action").alias("type"), "batch", F.lit(1).cast("bigint").alias("rows"))
    removed = versions.filter("ended_by = 'rollback'").groupBy(F.col("valid_to").alias("at")).agg(F.count(F.lit(1)).alias("rows"))
    taken = rollbacks.join(removed, "at", "left").select("at", F.lit("batch_rollback").alias("type"), "batch", F.coalesce("rows", F.lit(0)).alias("rows"))
    return changes.unionByName(taken)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], where: Column, order: list[str]) -> DataFrame:
    """The next version of a table with a unique index on keys over the rows where a condition holds, and action (kept, inserted).

    New rows for which the condition fails are always inserted. Of those for which it holds, the first by order of each
    key is inserted unless an old row under the condition has the key; nulls in keys count as "".
    """
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    ids = [f"_k{i}" for i in range(len(keys))]
    marked = new.withColumn("_where", F.coalesce(where, F.lit(False))).select("*", *named)
    taken = old.filter(F.coalesce(where, F.lit(False))).select(*named).distinct()
    fit = marked.filter("_where").join(taken, ids, "left_anti")
    # the first row of a key is found in each task before rows move
    first = fit.groupBy(*ids).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_row")).select("_row.*")
    added = first.unionByName(marked.filter("NOT _where").select(new.columns))
    return old.withColumn("action", F.lit("kept")).unionByName(added.withColumn("action", F.lit("inserted")))
