"""Candidates learned from corrections: a containment join of word sets, and matches raised and extended by earlier corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import tokens
from cardloom.session import written

#: The share of a query's words that a card's label must hold, the confidence of a card added so, the cards kept, and the least letters of a word.
LEAST_OVERLAP, ADDED, KEPT, LEAST_LETTERS = 0.25, 0.52, 7, 3


def long_words(text: Column | str) -> Column:
    """The words of three letters and more of a normalised text, repeats included."""
    return F.filter(F.coalesce(tokens(text), F.array().cast("array<string>")), lambda w: F.length(w) >= LEAST_LETTERS)


def contained_share(left: Column, right: Column) -> Column:
    """The share of the words of left, repeats included, that right holds; 0 if either is empty."""
    held = F.size(F.filter(left, lambda w: F.array_contains(right, w)))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), held / F.size(left)).otherwise(0.0)


def containment_join(queries: DataFrame, labels: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """query_id, id, share: pairs of which the label holds at least the share of the query's words.

    queries: query_id, words (repeats included); labels: id, words (distinct). Words are ranked by how many labels
    hold them. Of a query's n words a label must hold t = ceil(least * n), so it holds one of the n - t + 1 rarest: only these are looked
    up, and the commonest words make no pairs. Labels shorter than the distinct words needed are passed over before pairs are verified.
    """
    held = labels.select("id", F.explode("words").alias("word"), F.size("words").alias("_size"))
    df = held.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    asked = queries.select("query_id", F.size("words").alias("_n"), F.posexplode("words").alias("_at", "word")).join(df, "word", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("_df", "word", "_at"))
    need = F.ceil(F.col("_n") * least - 1e-9)
    rare = asked.withColumn("_turn", turn).filter((F.col("_turn") <= F.col("_n") - need + 1) & (F.col("_df") > 0))
    often = asked.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("_often")).groupBy("query_id").agg(F.max("_often").alias("_most"))
    prefix = rare.withColumn("_need", need).select("query_id", "word", "_need").distinct().join(often, "query_id")
    met = prefix.join(held, "word").filter(F.col("_size") * F.col("_most") >= F.col("_need")).select("query_id", "id").distinct()
    pairs = met.join(queries.select("query_id", F.col("words").alias("_left")), "query_id").join(labels.select("id", F.col("words").alias("_right")), "id")
    return pairs.withColumn("share", contained_share(F.col("_left"), F.col("_right"))).filter(F.col("share") >= least).select("query_id", "id", "share")


def best_added(regions: DataFrame, learned: DataFrame, said: DataFrame, most: int) -> DataFrame:
    """item, card_id: the most best of the corrected cards whose label holds a quarter of a region's words, by boost, ties the least id.

    regions: item, words; learned: id, words; said: card_id, reason. Nearly every pair may hold a quarter, as labels have words in common, so pairs are
    not listed: regions of equal words are one, and so are cards of equal label and reason words (a kind), by their least ids. Boosts come from the words
    that reasons and regions share. The kinds of a region's best reasons give a floor, and only kinds that can pass it are looked
    at further; kinds whose reasons share no word only for regions that the others leave short.
    """
    asked = written(regions.filter(F.size("words") > 0).select("item", F.array_sort("words").alias("words")))
    texts = written(asked.groupBy("words").agg(F.min("item").alias("q")))
    reasons = said.groupBy(F.col("card_id").alias("id")).agg(F.array_sort(F.collect_set(F.array_sort(long_words("reason")))).alias("reasons"))
    cards = written(learned.select("id", F.array_sort("words").alias("words")).join(reasons, "id"))
    place = F.row_number().over(Window.partitionBy("words", "reasons").orderBy("id"))
    kinds = written(cards.withColumn("_place", place).filter(F.col("_place") <= most).groupBy("words", "reasons").agg(F.min("id").alias("kind"), F.array_sort(F.collect_list("id")).alias("ids")))
    told = written(kinds.groupBy("reasons").agg(F.min("kind").alias("told"), F.sum(F.size("ids")).alias("n")))
    kinds = written(kinds.join(told, "reasons").select("told", "kind", "ids", F.col("words").alias("_label")))

    single = told.select("told", F.posexplode("reasons").alias("at", "_reason")).select("told", "at", F.size("_reason").alias("_size"), F.explode("_reason").alias("word"))
    single = single.groupBy("told", "at", "_size", "word").agg(F.count(F.lit(1)).alias("_times"))
    shared = texts.select("q", F.explode(F.array_distinct("words")).alias("word")).join(single, "word").groupBy("q", "told", "at", "_size").agg(F.sum("_times").alias("_held"))
    boosted = written(shared.groupBy("q", "told").agg(F.round(F.max(0.03 + F.col("_held") / F.col("_size") * 0.05), 6).alias("boost")))

    def held(pairs: DataFrame) -> DataFrame:
        """q, id, boost: the most best cards of the kinds in pairs (q, ids, boost, _label) that hold enough."""
        fine = pairs.join(texts, "q").filter(contained_share(F.col("words"), F.col("_label")) >= LEAST_OVERLAP).select("q", "boost", F.explode("ids").alias("id"))
        return best(fine)

    def best(rows: DataFrame) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("boost"), "id"))
        return rows.withColumn("_at", at).filter(F.col("_at") <= most)

    before = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("boost"), "told").rowsBetween(Window.unboundedPreceding, -1))
    first = boosted.join(told.select("told", "n"), "told").withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < most).select("q", "told", "boost")
    floor = written(held(first.join(kinds, "told")).filter(F.col("_at") == most).select("q", F.col("boost").alias("_floor"), F.col("id").alias("_last")))
    may = boosted.join(floor, "q", "left").filter("_floor IS NULL OR boost >= _floor").join(kinds, "told").filter("_floor IS NULL OR boost > _floor OR kind <= _last")
    found = written(held(may))
    short = texts.join(found.filter(F.col("_at") == most).select("q"), "q", "left_anti")
    rest = containment_join(short.select(F.col("q").alias("query_id"), "words"), kinds.select(F.col("kind").alias("id"), F.col("_label").alias("words")))
    rest = rest.select(F.col("query_id").alias("q"), F.col("id").alias("kind")).join(kinds, "kind").join(boosted.select("q", "told"), ["q", "told"], "left_anti")
    every = best(found.select("q", "id", "boost").unionByName(rest.select("q", F.explode("ids").alias("id"), F.lit(0.02).alias("boost"))))
    return asked.join(texts, "words").join(every.select("q", F.col("id").alias("card_id")), "q").select("item", "card_id")


def learned_candidates(regions: DataFrame, matches: DataFrame, corrections: DataFrame, cards: DataFrame) -> DataFrame:
    """item, rank, card_id, confidence, boost, added: the seven best cards of each region after earlier corrections.

    regions: item, text. matches: item, rank, card_id, confidence, match_score. corrections: card_id, reason. cards: card_id, label. A
    corrected card that is no match is added with confidence 0.52 if its label holds a quarter of the region's words. A card's boost is the most
    that one of its corrections gives: 0.02, or 0.03 and 0.05 of the share of the reason's words that the region (without words: the card's label)
    holds. Ties of confidence go to the higher match score, then to matches by rank, then to the smaller id. Null texts have no words.
    """
    region = written(regions.select("item", long_words("text").alias("words")))
    label = written(cards.select(F.col("card_id"), F.array_distinct(long_words("label")).alias("words")))
    learned = label.join(corrections.select("card_id").distinct(), "card_id", "left_semi").withColumnRenamed("card_id", "id")
    # corrections that say the same of a card count once
    said = corrections.select("card_id", F.coalesce("reason", F.lit("")).alias("reason")).distinct()
    matches = written(matches)
    # of the best cards some may be matches already, as many as a region has
    taken = matches.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    new = best_added(region, learned, said, KEPT + taken).join(matches.select("item", "card_id"), ["item", "card_id"], "left_anti")
    every = matches.select("item", "card_id", "rank", "confidence", "match_score", F.lit(False).alias("added")).unionByName(
        new.select("item", "card_id", F.lit(None).cast("int").alias("rank"), F.lit(ADDED).alias("confidence"), F.lit(0.0).alias("match_score"), F.lit(True).alias("added"))
    )
    met = every.select("item", "card_id").join(said, "card_id").join(region, "item", "left").join(label.withColumnRenamed("words", "_label"), "card_id", "left")
    seen = F.when(F.size("words") > 0, F.col("words")).otherwise(F.coalesce("_label", F.array().cast("array<string>")))
    share = contained_share(long_words("reason"), seen)
    boosts = met.groupBy("item", "card_id").agg(F.max(F.when(share > 0, 0.03 + share * 0.05).otherwise(0.02)).alias("boost"))
    raised = every.join(boosts, ["item", "card_id"], "left").withColumn("boost", F.round(F.coalesce("boost", F.lit(0.0)), 6))
    raised = raised.withColumn("confidence", F.least(F.lit(0.995), F.round(F.col("confidence") + F.col("boost"), 6)))
    order = Window.partitionBy("item").orderBy(F.desc("confidence"), F.desc("match_score"), F.asc_nulls_last("rank"), "card_id")
    return raised.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= KEPT).select("item", "rank", "card_id", "confidence", "boost", "added")
