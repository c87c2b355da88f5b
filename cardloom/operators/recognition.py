"""Candidates for a card in an image: reranking by evidence, ledgers of observations, decisions, learned boosts, card-aware sale scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import choose, clamp, half_up, jaccard, listed, normalize_text, tokens

#: What each field is worth in reranking, the fields whose sure contradiction is hard, and the least similarity that matches.
FIELD_WEIGHTS = {"player": 0.08, "year": 0.08, "sport": 0.04, "brand": 0.06, "set_name": 0.10, "card_number": 0.18}
HARD_FIELDS = ["card_number", "year"]
LOOSE_FIELDS = ["set_name", "brand"]
#: Score and margin from which a candidate is exact, or likely.
EXACT, LIKELY = (0.88, 0.07), (0.72, 0.035)
#: Weights of the fields of a sale that can be held against its card.
MATCH_WEIGHTS = {"player": 16, "set_name": 12, "card_number": 16, "parallel": 14, "year": 12, "grade": 10}


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def card_number(value: Column) -> Column:
    """A card's number in capitals, without the word card, # and signs."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(value)), r"^CARD\s*(NO\.?|NUMBER)?\s*", ""), "[^A-Z0-9]", "")


def field_similarity(field: str, seen: Column, held: Column) -> Column:
    """1 for equal values, for texts else the share of common words; null without evidence."""
    if field == "card_number":
        alike = F.when(card_number(seen) == card_number(held), 1.0).otherwise(0.0)
    elif field == "year":
        alike = F.when(seen == held, 1.0).otherwise(0.0)
    else:
        alike = F.when(normalize_text(seen) == normalize_text(held), 1.0).otherwise(jaccard(F.array_distinct(tokens(seen)), F.array_distinct(tokens(held))))
    return F.when(seen.isNotNull(), F.coalesce(alike, F.lit(0.0)))


def rerank(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """The candidates of each query by cosine and evidence, with rank, score, matched, conflicts, margin and status.

    candidates: query_id, card_id, cosine, the card's fields, and for each field seen_ (what the image
    shows, null if nothing) and sure_ (how sure that is). A field that agrees adds its weight, one
    that does not takes three quarters of it, or 1.65 times if the evidence is hard. The best
    candidate without a hard conflict is exact or likely if it is far enough ahead of the next such one.
    """
    out = candidates
    for field in FIELD_WEIGHTS:
        alike = field_similarity(field, F.col(f"seen_{field}"), F.col(field))
        agrees = alike >= (0.72 if field in LOOSE_FIELDS else 0.999)
        hard = (F.lit(field in HARD_FIELDS)) & (F.col(f"sure_{field}") >= 0.75) & ~agrees
        out = out.withColumns({f"_agrees_{field}": agrees, f"_hard_{field}": F.coalesce(hard, F.lit(False))})
    gain = lambda f, w: F.when(F.col(f"_agrees_{f}"), w).when(F.col(f"_hard_{f}"), -1.65 * w).otherwise(-0.75 * w) * F.col(f"sure_{f}")
    shift = total([F.coalesce(F.when(F.col(f"_agrees_{f}").isNotNull(), gain(f, w)), F.lit(0.0)) for f, w in FIELD_WEIGHTS.items()])
    out = out.withColumns(
        {
            "score": F.round(clamp(F.col("cosine") + shift, 0.0, 1.0), 6),
            "matched": listed(*[(F.col(f"_agrees_{f}"), f) for f in FIELD_WEIGHTS]),
            "conflicts": listed(*[(F.col(f"_hard_{f}"), f) for f in FIELD_WEIGHTS]),
        }
    ).drop(*[f"_{k}_{f}" for f in FIELD_WEIGHTS for k in ("agrees", "hard")])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("cosine"), "card_id")
    clear = F.size("conflicts") == 0
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    viable = F.sum(clear.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("query_id")
    out = out.withColumn("_viable", F.when(clear, viable))
    best, after = F.max(F.when(F.col("_viable") == 1, F.col("score"))).over(whole), F.max(F.when(F.col("_viable") == 2, F.col("score"))).over(whole)
    out = out.withColumn("margin", F.round(best - F.coalesce(after, F.lit(0.0)), 6))
    names = lambda *f: reduce(lambda a, b: a & b, [F.array_contains("matched", x) for x in f])
    backed = names("card_number") | names("set_name", "year")
    at_least = lambda level: (F.col("score") >= level[0]) & (F.col("margin") >= level[1])
    status = choose([(F.col("_viable") != 1, None), (at_least(EXACT) & backed, "exact"), (at_least(LIKELY), "likely")], "unresolved")
    return out.withColumn("status", F.when(F.col("_viable").isNotNull(), status)).drop("_viable")


def hard_constraints(candidates: DataFrame, **wanted: object) -> DataFrame:
    """Candidates whose fields equal the given ones; a field that is not given does not count."""
    for field, value in wanted.items():
        if value is not None:
            shown = F.col(field).cast("string")
            same = card_number(shown) == card_number(F.lit(str(value))) if field == "card_number" else normalize_text(shown) == normalize_text(F.lit(str(value)))
            candidates = candidates.filter(F.coalesce(same, F.lit(False)))
    return candidates


def in_scope(candidates: DataFrame, allowed: DataFrame | None, key: str = "card_id") -> DataFrame:
    """Candidates among the allowed ids. None allows all, an empty table none."""
    return candidates if allowed is None else candidates.join(allowed.select(key).distinct(), key, "left_semi")


def ledger(observations: DataFrame) -> DataFrame:
    """item, field, status, value, confidence, sources: what the observations of a field come to.

    observations: item, field, value, source, confidence. Values are groups by normal form, a group
    as sure as its surest observation. Two groups from 0.6 on are a conflict, without a value.
    """
    groups = observations.withColumn("_v", normalize_text("value")).groupBy("item", "field", "_v").agg(
        F.max("confidence").alias("c"), F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("confidence", "value")).alias("value")
    )
    best = F.max(F.struct("c", "n", "value"))
    g = groups.groupBy("item", "field").agg(best.alias("_best"), F.count_if(F.col("c") >= 0.6).alias("confident"))
    sources = observations.groupBy("item", "field").agg(F.count_distinct("source").alias("sources"))
    conflict = F.col("confident") >= 2
    shown = g.join(sources, ["item", "field"])
    return shown.select("item", "field", F.when(conflict, "conflicted").otherwise("supported").alias("status"), F.when(~conflict, F.col("_best.value")).alias("value"), F.when(~conflict, F.col("_best.c")).alias("confidence"), "sources")


def decide(ledgers: DataFrame, candidates: DataFrame, calibration: dict | None, least_fields: int = 2, gap: float = 0.08) -> DataFrame:
    """item, status, reasons, choices: accepted, review or abstained for each item of either table.

    candidates: item, rank, confidence. Without evidence or candidates, or with a conflict, the
    decision is not made; too few sure fields, close candidates or a calibration that does not hold call for review.
    """
    seen = ledgers.groupBy("item").agg(F.count(F.lit(1)).alias("fields"), F.count_if((F.col("status") == "conflicted") | (F.col("confidence") >= 0.6)).alias("supported"), F.count_if(F.col("status") == "conflicted").alias("conflicted"))
    top = candidates.filter("rank <= 3").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second"))
    both = seen.join(top, "item", "full").fillna(0, ["fields", "supported", "conflicted", "n"])
    clear = F.coalesce(F.round(F.col("first") - F.col("second"), 6) >= gap, F.lit(False))
    choices = F.when(clear & (F.col("n") > 1), F.lit(1).cast("long")).otherwise(F.col("n"))
    if calibration is None:
        doubt = "calibration_unavailable"
    elif calibration.get("sample_size", 0) < calibration.get("minimum_samples", 30):
        doubt = "calibration_insufficient_support"
    else:
        doubt = None if calibration.get("lower_bound", 0) >= calibration.get("target", 0.98) else "calibration_risk_bound_not_met"
    reasons = listed(
        (F.col("fields") == 0, "no_observed_identity_evidence"), (F.col("conflicted") > 0, "critical_evidence_conflict"), (F.col("n") == 0, "no_candidate"), (F.lit(doubt is not None), doubt or ""),
        ((F.col("fields") > 0) & (F.col("supported") < least_fields), "insufficient_observed_fields"), (choices > 1, "ambiguous_prediction_set"),
    )
    out = both.select("item", "fields", "conflicted", "n", choices.alias("choices"), reasons.alias("reasons"))
    status = choose([((F.col("fields") == 0) | (F.col("conflicted") > 0) | (F.col("n") == 0), "abstained"), (F.size("reasons") > 0, "review")], "accepted")
    return out.select("item", status.alias("status"), "reasons", "choices")


def learned_boosts(matches: DataFrame, corrections: DataFrame) -> DataFrame:
    """Matches (item, card_id, confidence, label) raised by earlier corrections of their card (card_id, reason): 0.02, or 0.03 and 0.05 of the word overlap, the most of all."""
    met = matches.join(corrections, "card_id")
    overlap = jaccard(F.array_distinct(tokens("reason")), F.array_distinct(tokens("label")))
    boosts = met.groupBy("item", "card_id").agg(F.max(F.when(overlap > 0, F.lit(0.03) + overlap * 0.05).otherwise(0.02)).alias("boost"))
    out = matches.join(boosts, ["item", "card_id"], "left").withColumn("boost", F.round(F.coalesce("boost", F.lit(0.0)), 6))
    return out.withColumn("confidence", F.least(F.lit(0.995), F.round(F.col("confidence") + F.col("boost"), 6)))


def pair_score(distance: Column, histogram: Column, matches: Column, inliers: Column, keypoints: Column) -> Column:
    """How alike two images are by hash distance, histograms and matched points; each part is full at its own level."""
    full = lambda x, at: F.least(F.lit(1.0), x / at)
    return F.round(0.12 * F.greatest(F.lit(0.0), 1 - distance / 24) + 0.16 * histogram + 0.23 * full(matches, 0.40) + 0.43 * full(inliers, 0.85) + 0.06 * full(keypoints, 80), 6)


def score_against_cards(sales: DataFrame, cards: DataFrame) -> DataFrame:
    """The sales with match_score and mismatch against the card they name.

    sales: card_id, said_ fields (player, set_name, card_number, parallel, year, grade) and confidence;
    cards: asked_id, card_id and the fields. The card counts 35, fields that both sides have by their weights. mismatch
    is the first of wrong_card, wrong_grade, wrong_parallel; a parallel that only the card has, with a match under 82, is unconfirmed.
    """
    held = cards.select(F.col("card_id").alias("_card"), *["asked_id", *[F.col(f).alias(f"_{f}") for f in MATCH_WEIGHTS]])
    joined = sales.join(held, "asked_id")
    said, own = (lambda f: F.lower(F.trim(F.col(f"said_{f}").cast("string")))), (lambda f: F.lower(F.trim(F.col(f"_{f}").cast("string"))))
    there = lambda f: F.coalesce((said(f) != "") & (own(f) != ""), F.lit(False))
    possible = total([F.when(there(f), float(w)).otherwise(0.0) for f, w in MATCH_WEIGHTS.items()]) + 35
    earned = total([F.when(there(f) & (said(f) == own(f)), float(w)).otherwise(0.0) for f, w in MATCH_WEIGHTS.items()]) + F.when(F.col("card_id") == F.col("_card"), 35.0).otherwise(0.0)
    out = joined.withColumn("match_score", half_up(clamp(earned / possible * 100 + F.coalesce("confidence", F.lit(0.0)) * 10, 1.0, 100.0)))
    differs = lambda f: there(f) & (said(f) != own(f))
    unconfirmed = F.coalesce(own("parallel") != "", F.lit(False)) & ~F.coalesce(said("parallel") != "", F.lit(False)) & (F.col("match_score") < 82)
    mismatch = choose([(F.coalesce(F.col("card_id") != F.col("_card"), F.lit(False)), "excluded_wrong_card"), (differs("grade"), "excluded_wrong_grade"), (differs("parallel"), "excluded_wrong_parallel"), (unconfirmed, "needs_review")])
    return out.withColumn("mismatch", mismatch).drop("_card", *[f"_{f}" for f in MATCH_WEIGHTS])
