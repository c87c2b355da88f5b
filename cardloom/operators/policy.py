"""Rules on sources, paths, images, queues and pages of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import choose
from cardloom.operators.normalize import APPROVED


def longest_rule(path: Column, rules: Column) -> Column:
    """Letters of the longest rule that a path begins with; 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: path.startswith(r)), F.length)), F.lit(0))


def path_decisions(rows: DataFrame, path: str = "path") -> DataFrame:
    """The rows with decision: allowed, or which list refuses the path.

    Columns allowed and disallowed are the source's own prefixes, robots_allow and robots_disallow
    those of its crawling rules. An own refusal is lifted by an own permission; of crawling rules the longest counts.
    """
    p = F.col(path)
    own = lambda c: longest_rule(p, F.col(c)) > 0
    refusals = [
        (own("disallowed") & ~own("allowed"), "disallowed_by_policy"),
        ((F.size("allowed") > 0) & ~own("allowed"), "not_in_allowed_paths"),
        (longest_rule(p, F.col("robots_disallow")) > longest_rule(p, F.col("robots_allow")), "disallowed_by_robots"),
    ]
    return rows.withColumn("decision", choose(refusals, "allowed"))


def image_rows(rows: DataFrame, cards: DataFrame, hosts: list[str]) -> DataFrame:
    """Image rows (card_id, image_url, basis) with host and reason; reason is null for accepted ones."""
    known = cards.select("card_id", F.lit(True).alias("_known")).distinct()
    host = F.nullif(F.regexp_extract(F.lower("image_url"), r"^https://([^/:?#]+)", 1), F.lit(""))
    joined = rows.join(known, "card_id", "left").withColumn("host", host)
    listed_host = F.coalesce(F.array_contains(F.array(*[(F.col("host") == h) | F.col("host").endswith("." + h) for h in hosts]), True), F.lit(False))
    reason = choose([(F.col("_known").isNull(), "unknown_card"), (~listed_host, "host_not_allowed"), (~F.coalesce(F.col("basis").isin(APPROVED), F.lit(False)), "not_authorized")])
    return joined.withColumn("reason", reason).drop("_known")


def unknown_cards(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """The rows whose card is not in the catalog, null ids among them."""
    return rows.join(cards.select("card_id"), "card_id", "left_anti")


def manifest_errors(rows: DataFrame, splits: list[str]) -> DataFrame:
    """error and rows: what is wrong with a manifest (asset_id, sha256, split, family), counted.

    Wrong forms are found row by row, repeated ids and hashes and families in several splits by grouping.
    """
    hexes = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    forms = rows.select(F.explode(F.array_compact(F.array(F.when(~hexes, "bad_hash"), F.when(~F.coalesce(F.col("split").isin(splits), F.lit(False)), "bad_split")))).alias("error"))
    again = lambda c, name: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("error"))
    leaks = rows.groupBy("family").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("family_in_several_splits").alias("error"))
    return forms.union(again("asset_id", "repeated_asset")).union(again("sha256", "repeated_hash")).union(leaks).groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


def keyset_page(rows: DataFrame, time: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The next rows after a cursor (time, key), latest first and then by falling key."""
    if cursor is not None:
        rows = rows.filter(F.struct(F.col(time), F.col(key)) < F.struct(F.lit(cursor[0]).cast(rows.schema[time].dataType).alias(time), F.lit(cursor[1]).cast(rows.schema[key].dataType).alias(key)))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def next_versions(drafts: DataFrame, key: str, version: str) -> DataFrame:
    """key and next_version: one more than the largest version of each key."""
    return drafts.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def newest(rows: DataFrame, owner: str, limit: int, *order: Column | str) -> DataFrame:
    """A log that keeps the newest rows of each owner."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).filter(F.col("_turn") <= limit).drop("_turn")


def last_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key in order."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def patched(rows: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows with corrected fields where a correction has them."""
    fixes = corrections.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(fixes, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def watch_triggers(watches: DataFrame, values: DataFrame) -> DataFrame:
    """Watches (owner, card_id, direction, target) with value and triggered: the value is at or beyond the target."""
    beyond = F.when(F.col("direction") == "above", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return watches.join(values.select("card_id", "value"), "card_id", "left").withColumn("triggered", F.coalesce(beyond, F.lit(False)))


def new_alerts(triggers: DataFrame, opened: DataFrame) -> DataFrame:
    """One alert for each owner, card and direction that is triggered and has none open."""
    keys = ["owner", "card_id", "direction"]
    return triggers.filter("triggered").groupBy(*keys).agg(F.min("target").alias("target"), F.first("value").alias("value")).join(opened.select(*keys), keys, "left_anti")


def enqueue(queue: DataFrame, images: DataFrame, priority: int, key: str = "image_id") -> DataFrame:
    """The queue with front and back images that may be used: finished work stays finished, other work waits, the larger priority counts."""
    wanted = images.filter(F.col("side").isin("front", "back") & F.coalesce("commercial_use", F.lit(False))).select(key, F.lit(priority).alias("_p"))
    joined = queue.join(wanted, key, "full")
    status = F.when(F.col("_p").isNull() | (F.col("status") == "complete"), F.col("status")).otherwise("pending")
    return joined.select(key, status.alias("status"), F.greatest("priority", "_p").alias("priority"))


def reference_images(old: DataFrame, rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Reference images by uri: rows that name a known card replace what they hold; gaps in hash and size keep the old values."""
    named = rows.join(cards.select("card_id", "card_key"), "card_key").drop("card_key")
    new = named.select("image_uri", *[F.col(c).alias(f"_{c}") for c in ("card_id", "side", "sha", "width")])
    joined = old.join(new, "image_uri", "full")
    fresh = F.col("_card_id").isNotNull()
    return joined.select("image_uri", F.when(fresh, F.col("_card_id")).otherwise(F.col("card_id")).alias("card_id"), F.when(fresh, F.col("_side")).otherwise(F.col("side")).alias("side"), F.coalesce("_sha", "sha").alias("sha"), F.coalesce("_width", "width").alias("width"))


def provider_coverage(providers: DataFrame, sales: DataFrame) -> DataFrame:
    """providers (provider, completed_sales, rights) with the number of their sales, and whether they are stale: none although they could."""
    counts = sales.groupBy("provider").agg(F.count(F.lit(1)).alias("sales"))
    n = F.coalesce("sales", F.lit(0))
    return providers.join(counts, "provider", "left").select("provider", "rights", n.alias("sales"), (F.col("completed_sales") & (n == 0) & (F.col("rights") != "demo_only")).alias("stale"))


def idempotency_key(**parts: Column) -> Column:
    """sha256 of the parts as JSON with sorted names; null parts are left out."""
    return F.sha2(F.to_json(F.struct(*[column.alias(name) for name, column in sorted(parts.items())])), 256)
