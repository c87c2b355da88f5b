"""Recognition benchmarks: images brought to labels, found items to expected cards, and what was right by scene and field."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import half_up, normalize_text
from cardloom.session import written

#: Fields that are scored, those of them that tell a card apart, and the share and number of these that must agree.
FIELDS = ["player", "year", "brand", "set_name", "card_number", "parallel", "product_name", "product_type", "configuration", "upc", "grader", "grade", "cert_number"]
IDENTITY = ["player", "year", "brand", "set_name", "card_number", "parallel", "product_name", "product_type", "configuration", "upc"]
AGREEING, LEAST = 0.72, 3
#: The confidence from which a wrong match is a false confident one, scenes of many cards, and the accuracy below which a field is weak.
CONFIDENT, HARD_SCENES, WEAK = 0.86, ["binder_page", "multi_card_table", "mixed_raw_slab"], 85.0
FOCUS = "multi_card_binder_focus"
IMAGE_ENDINGS = ["jpg", "jpeg", "png", "webp", "avif"]


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal, halves up; 0 of nothing."""
    return F.when(whole > 0, half_up(part * 1000 / whole) / 10).otherwise(0.0)


def image_key(name: Column) -> Column:
    """Letters and digits of a file's name, without folders and ending."""
    file = F.regexp_extract(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.replace(normalize_text(F.regexp_replace(file, r"\.[A-Za-z0-9]+$", "")), F.lit(" "), F.lit(""))


def images_with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """key, image, label_id, status: each image of a supported kind with the label of its key, and the labels without one.

    images have image, labels label_id and name (a file's name). Of labels that share a key the least id counts; the others are repeated labels.
    status is paired, unlabeled_image, unmatched_label or repeated_label. Images that share a key are each paired. Empty keys match nothing.
    """
    fit = F.lower(F.regexp_extract(F.coalesce("image", F.lit("")), r"\.([A-Za-z0-9]+)$", 1)).isin(IMAGE_ENDINGS)
    shown = images.filter(fit).select(image_key(F.col("image")).alias("key"), "image")
    # the least id of a key is found in each task first, so a key of most labels is brought together by no one
    keyed = labels.select(image_key(F.col("name")).alias("key"), "label_id")
    first = keyed.filter("key <> ''").groupBy("key").agg(F.min("label_id").alias("label_id"))
    met = shown.join(first, "key", "full_outer")
    status = F.when(F.col("label_id").isNull(), "unlabeled_image").when(F.col("image").isNull(), "unmatched_label").otherwise("paired")
    paired = met.select("key", "image", "label_id", status.alias("status"))
    others = keyed.join(first.select("label_id"), "label_id", "left_anti")
    named = F.when(F.col("key") == "", "unmatched_label").otherwise("repeated_label")
    return paired.unionByName(others.select("key", F.lit(None).cast("string").alias("image"), "label_id", named.alias("status")))


def told(rows: DataFrame, fields: list[str]) -> Column:
    """An array of the fields' values as they are (raw) and in normal form (plain); "" for those that are null or missing."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) if f in rows.columns else F.lit("") for f in fields]
    return F.array(*[F.struct(t.alias("raw"), normalize_text(t).alias("plain")) for t in texts])


def agrees(expected: Column, actual: Column) -> Column:
    """Whether a value of told() is as expected: equal, or one within the other in normal form; null where nothing is expected."""
    e, a = expected["plain"], actual["plain"]
    near = (e != "") & (a != "") & (F.contains(a, e) | F.contains(e, a))
    return F.when(expected["raw"] != "", (actual["raw"] != "") & ((expected["raw"] == actual["raw"]) | near))


def is_card(fields: list[str]) -> Column:
    """Whether a match (found_id, found) is the expected card (card_id, expected): by id, or by enough of the fields that are expected."""
    known = len([f for f in IDENTITY if f in fields])
    told_ = F.filter(F.zip_with(F.slice("expected", 1, known), F.slice("found", 1, known), agrees), lambda t: t.isNotNull())
    asked, right = F.size(told_), F.size(F.filter(told_, lambda t: t))
    by_fields = (asked > 0) & (right >= AGREEING * asked) & (right >= F.least(F.lit(LEAST), asked))
    return F.coalesce(F.col("card_id") == F.col("found_id"), F.lit(False)) | F.coalesce(by_fields, F.lit(False))


def least_cost(cost: np.ndarray) -> list[int]:
    """For each row its own column so that the costs add up to the least: shortest augmenting paths over rows and columns (rows <= columns)."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[at]:
            done[at] = True
            open_ = np.flatnonzero(~done[1:]) + 1
            over = cost[row_of[at] - 1, open_ - 1] - u[row_of[at]] - v[open_]
            better = over < least[open_]
            least[open_[better]], came[open_[better]] = over[better], at
            next_ = open_[least[open_].argmin()]
            step = least[next_]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            at = next_
        while at:
            row_of[at] = row_of[came[at]]
            at = came[at]
    out = [0] * n
    for column in range(1, m + 1):
        if row_of[column]:
            out[row_of[column] - 1] = column - 1
    return out


def assigned(expected: DataFrame, items: DataFrame) -> DataFrame:
    """case_id, at, item_at: expected cards and found items of each case, each item for one card, so that most fields agree in all.

    Both tables have case_id, at and fields; a case's cards and items are those of one image. Ties go to the least places. Cards
    beyond the items have none (null item_at).
    """
    shared = [f for f in FIELDS if f in expected.columns and f in items.columns]
    named = lambda rows, role: rows.select("case_id", F.lit(role).alias("role"), "at", told(rows, shared).alias("told")).select("case_id", "role", "at", "told.raw", "told.plain")

    def agreeing(e: tuple, a: tuple) -> int:
        return sum(bool(x and y and (x == y or (p and q and (p in q or q in p)))) for x, y, p, q in zip(e[0], a[0], e[1], a[1], strict=True))

    def match(case: pd.DataFrame) -> pd.DataFrame:
        cards = case[case["role"] == "card"].sort_values("at")
        found = case[case["role"] == "item"].sort_values("at")
        wide = max(len(cards), len(found))
        cost = np.zeros((len(cards), wide))
        for i, card in enumerate(zip(cards["raw"], cards["plain"], strict=True)):
            for j, item in enumerate(zip(found["raw"], found["plain"], strict=True)):
                # a small share of the place, so that of equal assignments the straightest is taken
                cost[i, j] = -agreeing(card, item) + abs(i - j) / (4.0 * wide * wide)
        places = list(found["at"]) + [None] * (wide - len(found))
        chosen = least_cost(cost) if len(cards) else []
        return pd.DataFrame({"case_id": cards["case_id"].to_numpy(), "at": cards["at"].to_numpy(), "item_at": pd.array([places[j] for j in chosen], dtype="Int64")})

    kind = expected.schema["case_id"].dataType.simpleString()
    return named(expected, "card").unionByName(named(items, "item")).groupBy("case_id").applyInPandas(match, f"case_id {kind}, at bigint, item_at bigint")


def in_place(expected: DataFrame, items: DataFrame) -> DataFrame:
    """case_id, at, item_at: the item at a card's own place, else the first item; null for a case without items."""
    held = items.select("case_id", F.col("at").alias("item_at"))
    own = expected.select("case_id", "at").join(held.withColumn("at", F.col("item_at")), ["case_id", "at"], "left")
    first = held.groupBy("case_id").agg(F.min("item_at").alias("_first"))
    return own.join(first, "case_id", "left").select("case_id", "at", F.coalesce("item_at", "_first").alias("item_at"))


def score_cards(expected: DataFrame, items: DataFrame, matches: DataFrame, places: DataFrame) -> DataFrame:
    """One row for each expected card: case_id, at, best_match, best_confidence, top1, top3, false_confident, needs_confirmation and fields (field, correct).

    expected: case_id, at, card_id and fields. items: case_id, at, needs_confirmation and the fields that were read. matches: case_id, at, rank,
    confidence, card_id and the card's fields. places: case_id, at, item_at. Only the three first matches of an item are looked at.
    """
    fields = [f for f in FIELDS if f in expected.columns]  # those of IDENTITY come first
    cards = written(expected.select("case_id", "at", "card_id", told(expected, fields).alias("expected")).join(places, ["case_id", "at"], "left"))
    read = items.select("case_id", F.col("at").alias("item_at"), "needs_confirmation", told(items, fields).alias("facts"))
    top = matches.filter("rank <= 3").select("case_id", F.col("at").alias("item_at"), "rank", "confidence", F.col("card_id").alias("found_id"), told(matches, fields).alias("found"))
    judged = cards.join(top, ["case_id", "item_at"]).withColumn("_is", is_card(fields)).groupBy("case_id", "at").agg(
        F.bool_or(F.col("_is") & (F.col("rank") == 1)).alias("top1"), F.bool_or("_is").alias("top3"),
        F.max(F.when(F.col("rank") == 1, F.col("found_id"))).alias("best_match"), F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("best_confidence"),
    )
    out = cards.join(read, ["case_id", "item_at"], "left").join(judged, ["case_id", "at"], "left")
    facts = F.coalesce("facts", F.transform("expected", lambda _: F.struct(F.lit("").alias("raw"), F.lit("").alias("plain"))))
    right = F.zip_with("expected", facts, agrees)
    details = F.filter(F.zip_with(F.array(*map(F.lit, fields)), right, lambda f, ok: F.struct(f.alias("field"), ok.alias("correct"))), lambda x: x["correct"].isNotNull())
    no = F.lit(False)
    top1, asks = F.coalesce("top1", no), F.coalesce("needs_confirmation", no)
    return out.select(
        "case_id", "at", "best_match", "best_confidence", top1.alias("top1"), F.coalesce("top3", no).alias("top3"),
        (~top1 & (F.coalesce("best_confidence", F.lit(0.0)) >= CONFIDENT) & ~asks).alias("false_confident"), asks.alias("needs_confirmation"), details.alias("fields"),
    )


def by_scene(cases: DataFrame, scored: DataFrame) -> DataFrame:
    """scene, cases, expected and percents: for each expected scene, for all (scene 'all') and for scenes of many cards (FOCUS).

    cases: case_id, scene_expected, scene_actual, scorable; those that are not scorable do not count. Each case adds to two or three rows, summed in one pass.
    """
    right, asked = F.size(F.filter("fields", lambda f: f["correct"])), F.size("fields")
    flags = [F.sum(F.col(c).cast("long")).alias(c) for c in ("top1", "top3", "false_confident", "needs_confirmation")]
    sums = scored.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"), *flags, F.sum(right).alias("right"), F.sum(asked).alias("asked"))
    rows = cases.filter("scorable").join(sums, "case_id", "left").fillna(0, ["expected", "top1", "top3", "false_confident", "needs_confirmation", "right", "asked"])
    hard = F.col("scene_expected").isin(HARD_SCENES) | (F.col("expected") > 1)
    labels = F.array_compact(F.array(F.coalesce("scene_expected", F.lit("unknown")), F.lit("all"), F.when(hard, F.lit(FOCUS))))
    same = F.coalesce(normalize_text("scene_expected") == normalize_text("scene_actual"), F.lit(False))
    g = rows.select("*", same.cast("int").alias("same"), F.explode(labels).alias("scene")).groupBy("scene").agg(
        F.count(F.lit(1)).alias("cases"), *[F.sum(c).alias(c) for c in ("expected", "same", "top1", "top3", "false_confident", "needs_confirmation", "right", "asked")]
    )
    of = {"scene_accuracy": ("same", "cases"), "top1_accuracy": ("top1", "expected"), "top3_accuracy": ("top3", "expected"), "field_accuracy": ("right", "asked"), "false_confident_rate": ("false_confident", "expected"), "needs_confirmation_rate": ("needs_confirmation", "expected")}
    return g.select("scene", "cases", "expected", *[percent(F.col(a), F.col(b)).alias(name) for name, (a, b) in of.items()])


def by_field(scored: DataFrame) -> DataFrame:
    """field, total, correct, accuracy and weak for each field that was expected."""
    g = scored.select(F.explode("fields").alias("f")).groupBy("f.field").agg(F.count(F.lit(1)).alias("total"), F.count_if("f.correct").alias("correct"))
    out = g.withColumn("accuracy", percent(F.col("correct"), F.col("total")))
    return out.withColumn("weak", F.col("accuracy") < WEAK)


def failures(cases: DataFrame, scored: DataFrame, most: int = 8) -> DataFrame:
    """pattern, found and examples: how often recognition failed in each way, and the first cards or cases by id and place.

    Examples are the first most by case and place; only these are gathered.
    """
    kinds = [
        ("missed_top1", ~F.col("top1")), ("correct_in_top3", ~F.col("top1") & F.col("top3")), ("false_confident", F.col("false_confident")), ("needs_confirmation", F.col("needs_confirmation")),
    ]
    patterns = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in kinds]))
    known = cases.filter("scorable")
    per_card = scored.join(known.select("case_id"), "case_id", "left_semi").select(F.explode(patterns).alias("pattern"), "case_id", "at")
    same = F.coalesce(normalize_text("scene_expected") == normalize_text("scene_actual"), F.lit(False))
    per_case = known.filter(~same).select(F.lit("scene_miss").alias("pattern"), "case_id", F.lit(0).cast("bigint").alias("at"))
    rows = per_card.unionByName(per_case)
    turn = F.row_number().over(Window.partitionBy("pattern").orderBy("case_id", "at"))
    shown = rows.withColumn("_turn", turn).filter(F.col("_turn") <= most)
    listed = shown.groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_turn", F.concat_ws(":", "case_id", "at").alias("x")))), lambda s: s["x"]), ",").alias("examples"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("found")).join(listed, "pattern")
