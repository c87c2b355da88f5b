"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.line_dedup import wide_hash
from cardloom.llm.text import WORD, text_or_empty, words_of
from cardloom.session import cut, table, written

#: Hash ranges of a source's documents; only the one in which its share ends is put in order.
RANGES = 1024


def word_count(text: Column | str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Add target to sources (weight, source_size): shares of the total by weight, none above max_epochs times its size.

    Each round clamps the sources whose share is above their limit and gives what is left to the
    others by weight; sources only ever become clamped, so the rounds end. A round sends three sums
    to the driver, however many sources there are.
    """
    limit = F.col("source_size") * F.lit(float(max_epochs))
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, clamped_before = None, -1
    while True:
        # level: words for each unit of weight among the sources not clamped
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= limit
        held, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(clamped, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
            F.count(F.when(clamped, 1)),
        ).first()
        if n == clamped_before or not weight:
            return sources.withColumn("target", F.when(clamped, limit).otherwise(F.col("weight") * F.lit(level or 0.0)))
        clamped_before, level = n, (total - held) / float(weight)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Words to take from each document so that the sources meet their targets.

    Returns key, source, size, source_size, target, taken, copies and part: the document's words,
    its source's words and target, the words taken, the whole repetitions, and the words of one
    more repetition that is cut short (0: none). Sources in code-point order, null last, have the
    weights in turn. A source's target is met to the word: all its documents repeat as often as the
    target holds the whole source; documents in the order of a seeded hash repeat once more until
    the rest is used up, the last of them only with its first words.

    Null and word-free texts have size 0 and are never taken. Repeated rows are told apart only by
    chance of order, so the rows returned are the same on every run. A source without words gets
    nothing. An empty table gives an empty result. Other columns are dropped, but for those to carry.
    Texts are read once; narrow rows are written and all else works on them. The documents of a
    source are never brought together: their sums over hash ranges are, and the documents of the
    one range in which the source's share ends.
    """
    order = F.xxhash64(F.lit(seed), F.col(key), F.col("size"))
    narrow = docs.select(F.col(key), F.col(source).alias("source"), word_count(text).alias("size"), *carry)
    narrow = narrow.select("*", F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name")).alias("_source"), order.alias("_order"))
    narrow = cut(narrow.withColumn("_range", F.pmod(F.col("_order"), F.lit(RANGES)).cast("int")))

    ranges = cut(narrow.groupBy("_source", "_range").agg(F.sum("size").alias("_words")))
    sources = ranges.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("_source")) - 1) % len(weights)  # one narrow row for each source
    sources = cut(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))))
    targets = water_fill(sources, max_epochs)
    goal = F.least(F.floor(F.col("target") + F.lit(0.5)), F.floor(F.col("source_size") * F.lit(float(max_epochs))))
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.select("_source", "source_size", "target", whole.cast("long").alias("_whole"), goal.cast("long").alias("_goal"))
    targets = cut(targets.withColumn("_rest", F.col("_goal") - F.col("_whole") * F.col("source_size")).drop("_goal"))

    upto = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    plan = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0))).join(targets, "_source")
    rows = narrow.join(plan, ["_source", "_range"])
    ends = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest"))
    inside = rows.filter(~ends).withColumn("part", F.when(F.col("_before") < F.col("_rest"), F.col("size")).otherwise(F.lit(0)))
    earlier = Window.partitionBy("_source").orderBy("_order", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    edge = rows.filter(ends).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    both = inside.unionByName(edge)
    full = F.col("part") >= F.col("size")
    return both.select(
        key, "source", "size", "source_size", "target", *carry,
        (F.col("_whole") * F.col("size") + F.col("part")).alias("taken"),
        F.when(F.col("size") > 0, F.col("_whole") + F.when(full, 1).otherwise(0)).otherwise(0).cast("long").alias("copies"),
        F.when(full, F.lit(0)).otherwise(F.col("part")).cast("long").alias("part"),
    )


def row_id(*columns: str) -> Column:
    """128 bits that tell rows apart; rows equal in the columns share them."""
    first, second = wide_hash(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))
    return F.struct(first.alias("a"), second.alias("b"))


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as mix() repeats it, and cut to its first words where a repetition is cut short.

    Columns stay as they are; a cut text has its words joined by single spaces. Equal rows are
    repeated by the sum of their repetitions. Documents that are not taken do not appear.
    """
    named = docs.withColumn("_row", row_id(key, text, source))
    plan = mix(named, weights, max_epochs, seed, key, text, source, carry=("_row",))
    plan = plan.filter((F.col("copies") > 0) | (F.col("part") > 0)).groupBy("_row").agg(F.sum("copies").alias("_copies"), F.max("part").alias("_part"))
    both = named.dropDuplicates(["_row"]).join(written(plan), "_row")
    times = (F.col("_copies") + F.when(F.col("_part") > 0, 1).otherwise(0)).cast("int")
    turns = both.withColumn("_turn", F.explode(F.sequence(F.lit(1), times)))
    cut_short = F.array_join(F.slice(words_of(text_or_empty(text)), F.lit(1), F.col("_part").cast("int")), " ")
    return turns.withColumn(text, F.when(F.col("_turn") > F.col("_copies"), cut_short).otherwise(F.col(text))).select(docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3 by source, no source above three epochs."""
    taken = mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
