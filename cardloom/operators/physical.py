"""Photos of one physical item: a cascade of evidence over views in content order, under one front and one back for each item."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.operators.components import linked_groups
from cardloom.operators.hashes import banded, distance
from cardloom.operators.order import in_order, numbered
from cardloom.session import spread, written

#: Evidence from the strongest on, with its confidence.
METHODS = [("exact_content_duplicate", 0.999), ("cert_match", 0.995), ("serial_match", 0.98), ("visual_duplicate_with_capture_time", 0.90), ("front_back_identity", 0.88), ("unique", 1.0)]
#: Bits of 64 and seconds within which two shots are one view, and the confidence from which an identity pairs sides.
VIEW_BITS, VIEW_SECONDS, SURE = 5, 240, 0.9
SIDES = ("front", "back")


def identity_of(parts: list[Column], number: Column, cert: Column) -> Column:
    """One text of the normalised parts; null unless three are filled and there is a card number or certificate."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))
    filled = sum((F.when(plain(p) != "", 1).otherwise(0) for p in parts), F.lit(0))
    return F.when((filled >= 3) & ((plain(number) != "") | (plain(cert) != "")), F.concat_ws("|", *map(plain, parts)))


def unique_serial(text: Column) -> Column:
    """The first number of a print run such as 12/99 in a text, without spaces; null where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<!\d)(\d{1,6}\s*/\s*\d{1,7})(?!\d)", 1)
    return F.nullif(F.regexp_replace(found, r"\s", ""), F.lit(""))


def first_with(views: DataFrame, keys: list[str], turn: int) -> DataFrame:
    """_at, turn, parent: each view's first one with the same keys, where that is another. Hot keys: minima are taken in each task first."""
    known = views.dropna(subset=keys).select("_at", *keys)
    firsts = known.groupBy(*keys).agg(F.min("_at").alias("parent"))
    return known.join(spread(firsts), keys).filter("parent < _at").select("_at", F.lit(turn).alias("turn"), "parent")


def first_near(views: DataFrame, turn: int) -> DataFrame:
    """_at, turn, parent: each view's first one of a like fingerprint shot close in time.

    Views equal in both are one, with the first place. Likeness within five bits leaves one of six bands equal;
    bands meet in slots of time, so only shots of one session do.
    """
    shots = views.select("_at", F.array("fingerprint").alias("hash"), F.unix_micros(F.col("captured_at").cast("timestamp")).alias("_when")).dropna()
    reps = written(shots.groupBy("hash", "_when").agg(F.min("_at").alias("first")))
    slot = F.floor(F.col("_when") / F.lit(VIEW_SECONDS * 1_000_000)).cast("long")
    listed = banded(reps, 64, VIEW_BITS + 1, 0, False).withColumn("_slot", slot)
    asked = listed.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1))).select(F.col("hash").alias("_x"), F.col("_when").alias("_then"), "_slot", "at", "key")
    near = (distance(F.col("_x"), F.col("hash"), 1) <= VIEW_BITS) & (F.abs(F.col("_when") - F.col("_then")) <= VIEW_SECONDS * 1_000_000)
    parents = asked.join(spread(listed), ["_slot", "at", "key"]).filter(near).groupBy(F.col("_x").alias("hash"), F.col("_then").alias("_when")).agg(F.min("first").alias("parent"))
    return shots.join(spread(parents), ["hash", "_when"]).filter("parent < _at").select("_at", F.lit(turn).alias("turn"), "parent")


def fold_sides(events: DataFrame) -> DataFrame:
    """root and group of the trees that join another group; events are tree's first views of an identity and side, by component in order.

    A component's events stream through one task. It holds the sides of the component's groups and,
    for each identity and side, the groups that may still take the other side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group_of, sides, open_ = None, {}, {}, {}
        for batch in batches:
            out = []
            for component, at, root, identity, side, seeks in batch[["component", "at", "root", "identity", "side", "seeks"]].itertuples(index=False):
                if component != now:
                    now, group_of, sides, open_ = component, {}, defaultdict(set), defaultdict(deque)
                if at == root and seeks:
                    waiting = open_[identity, SIDES[side == "front"]]
                    while waiting and side in sides[waiting[0]]:
                        waiting.popleft()  # it has both sides for good
                    if waiting:
                        group_of[root] = waiting[0]
                        out.append((root, waiting[0]))
                group = group_of.get(root, root)
                sides[group].add(side)
                if identity is not None:
                    open_[identity, side].append(group)
            yield pd.DataFrame(out, columns=["root", "group"], dtype="int64")

    ordered = events.repartition("component").sortWithinPartitions("component", "at")
    return ordered.mapInPandas(run, "root bigint, group bigint")


def paired_sides(views: DataFrame) -> DataFrame:
    """root and group: the trees whose first view joins an earlier one's group as its other side.

    views have _at, root, identity, side and seeks. A view takes the first group that shows the other side of its identity and not
    yet its own. Where all trees of an identity show one side and seek, that pairs the n-th front
    with the n-th back, so they are only numbered, however many there are. Identities that other trees touch are
    folded in order, together with those they are linked with.
    """
    shown = views.filter(F.col("side").isin(*SIDES))
    trees = shown.groupBy("root").agg(
        F.min("side").alias("side"), F.min("identity").alias("identity"), F.max("seeks").alias("_seeks"), F.count(F.lit(1)).alias("_n"),
        F.count("identity").alias("_known"), F.max("side").alias("_last"), F.max("identity").alias("_most"),
    )
    plain = F.col("_seeks") & (F.col("side") == F.col("_last")) & (F.col("_n") == F.col("_known")) & (F.col("identity") == F.col("_most"))
    trees = written(trees.filter("_known > 0").select("root", "side", "identity", F.coalesce(plain, F.lit(False)).alias("plain")))
    mixed = trees.filter("NOT plain").select("root")
    touched = written(shown.filter("identity IS NOT NULL").join(spread(mixed), "root", "left_semi").select("root", "identity").distinct())
    least = touched.groupBy("identity").agg(F.min("root").alias("least"))
    components = linked_groups(mixed.withColumnRenamed("root", "id"), touched.join(spread(least), "identity").select(F.col("root").alias("a"), F.col("least").alias("b")))
    of_identity = written(least.join(spread(components.withColumnRenamed("id", "least")), "least").select("identity", F.col("group").alias("component")))

    simple = trees.filter("plain").join(spread(of_identity), "identity", "left_anti")
    placed = numbered(in_order(simple.select("identity", "side", "root"), [F.col("identity"), F.col("side"), F.col("root")]), ["identity", "side"], "n")
    fronts, backs = (placed.filter(F.col("side") == s).select("identity", "n", F.col("root").alias(s)) for s in SIDES)
    pairs = fronts.join(spread(backs), ["identity", "n"]).select(F.greatest(*SIDES).alias("root"), F.least(*SIDES).alias("group"))

    by_tree = components.select(F.col("id").alias("root"), F.col("group").alias("component"))
    by_tree = by_tree.union(trees.filter("plain").join(spread(of_identity), "identity").select("root", "component"))
    events = shown.groupBy("root", "identity", "side").agg(F.min("_at").alias("at"), F.max("seeks").alias("seeks")).join(spread(by_tree), "root")
    return pairs.union(fold_sides(events))


def physical_items(views: DataFrame) -> DataFrame:
    """id, group (the id of the group's first view), method and confidence for each view.

    views have id, content_hash, fingerprint (64 bits as a long), captured_at, identity, identity_confidence, side, cert and serial; each is an image of its own. Views are taken by content hash, then id, so
    the order in which they come has no say. A view joins the group of the first earlier one with the same content, else the same certificate, else the
    same serial and identity, else a like fingerprint shot within four minutes; else, if its identity is sure, the first group that shows the other side of
    that identity and not yet its own; else it starts a group. Nulls match nothing, null hashes come first, and sides but front and back are
    unknown. Repeated rows share content and so a group. Ids are unique; an empty table gives an empty one, and other columns are dropped.

    The first four rules look only at views, so all views find their parent at once, and stars over these links give trees with
    their first view. The last rule looks at what groups show at the time; see paired_sides.
    """
    known = ["content_hash", "fingerprint", "captured_at", "identity", "identity_confidence", "side", "cert", "serial"]
    placed = in_order(views.select("id", *known), [F.coalesce("content_hash", F.lit("")), F.col("id")])
    parents = first_with(placed, ["content_hash"], 0).unionByName(first_with(placed, ["cert"], 1)).unionByName(first_with(placed, ["serial", "identity"], 2)).unionByName(first_near(placed, 3))
    parents = written(parents.groupBy("_at").agg(F.min(F.struct("turn", "parent")).alias("best")).select("_at", "best.turn", "best.parent"))
    trees = linked_groups(placed.select(F.col("_at").alias("id")), parents.select(F.col("_at").alias("a"), F.col("parent").alias("b")))
    found = placed.join(spread(trees.select(F.col("id").alias("_at"), F.col("group").alias("root"))), "_at").join(spread(parents.select("_at", "turn")), "_at", "left")
    seeks = (F.col("_at") == F.col("root")) & F.col("identity").isNotNull() & (F.col("identity_confidence") >= SURE) & F.col("side").isin(*SIDES)
    found = written(found.select("id", "_at", "root", "turn", "identity", "side", F.coalesce(seeks, F.lit(False)).alias("seeks")))
    joined = written(paired_sides(found))
    group = F.coalesce("group", "root")
    turn = F.coalesce("turn", F.when(F.col("group").isNotNull(), 4).otherwise(5))
    named = found.join(spread(joined), "root", "left").select("id", group.alias("_first"), turn.alias("_turn"))
    firsts = found.select(F.col("_at").alias("_first"), F.col("id").alias("group"))
    method = F.element_at(F.array(*[F.lit(m) for m, _ in METHODS]), F.col("_turn") + 1)
    sure = F.element_at(F.array(*[F.lit(c) for _, c in METHODS]), F.col("_turn") + 1)
    return named.join(spread(firsts), "_first").select("id", "group", method.alias("method"), sure.alias("confidence"))
