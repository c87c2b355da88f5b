"""Phrases of a dictionary found in texts, the leftmost and longest first, and what titles say of a card by them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.expr import choose, normalize_text
from cardloom.operators.listings import card_numbers, title_grade
from cardloom.session import written

#: Bytes of phrases up to which the dictionary goes to every task as an automaton.
AUTOMATON_BYTES = 64 << 20
#: Words that name a parallel, in order, and those that name a sport.
PARALLELS = {"refractor": "Refractor", "silver": "Silver", "holo": "Holo", "rookie": "Rookie"}
SPORTS = {"pokemon": "Pokemon", "charizard": "Pokemon", "wwe": "Wrestling", "ufc": "MMA"}
FOUND = "array<struct<start:int,words:int,phrase:string>>"


def automaton_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """id and hits (start, words, phrase) of all phrases in each text, by one pass of an automaton over the letters."""
    held = [r["phrase"] for r in phrases.select("phrase").distinct().collect()]  # within AUTOMATON_BYTES, which the caller has checked
    spread = texts.sparkSession.sparkContext.broadcast(held)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in spread.value:
            automaton.add_word(f" {phrase} ", phrase)
        if spread.value:
            automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                line, hits = f" {text} ", []
                before = {at: n for n, at in enumerate(i for i, c in enumerate(line) if c == " ")}
                for end, phrase in automaton.iter(line) if spread.value else ():
                    hits.append({"start": before[end - len(phrase) - 1], "words": phrase.count(" ") + 1, "phrase": phrase})
                out.append(hits)
            struct = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("phrase", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(struct))], ["id", "hits"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, hits {FOUND}")


def joined_hits(texts: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """id and hits like automaton_hits, for dictionaries of any size: runs of words of a text meet equal phrases in a join."""
    words = texts.select("id", F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    starts = words.select("id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)))).alias("start")).filter(F.size("w") > 0)
    runs = starts.select("id", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("start")))).alias("words"), "w")
    named = runs.select("id", "start", "words", F.array_join(F.slice("w", F.col("start") + 1, F.col("words")), " ").alias("phrase"))
    hits = named.join(phrases.select("phrase").distinct(), "phrase").groupBy("id").agg(F.collect_list(F.struct("start", "words", "phrase")).alias("hits"))
    return texts.select("id").join(hits, "id", "left").select("id", F.coalesce("hits", F.array().cast(FOUND)).alias("hits"))


def leftmost_longest(hits: Column) -> Column:
    """Hits without overlaps: from the left, the longest that begins at a word; then on behind it."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["words"]).alias("less"), h["phrase"].alias("phrase"))))
    none = F.struct(F.lit(0).alias("free"), F.array().cast(FOUND).alias("kept"))

    def step(state: Column, h: Column) -> Column:
        kept = F.array_append(state["kept"], F.struct(h["start"].alias("start"), (-h["less"]).alias("words"), h["phrase"].alias("phrase")))
        taken = F.struct((h["start"] - h["less"]).alias("free"), kept.alias("kept"))
        return F.when(h["start"] >= state["free"], taken).otherwise(state)

    return F.aggregate(ordered, none, step)["kept"]


def find_phrases(texts: DataFrame, phrases: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """id and found (start, words, phrase) of the phrases that each text holds as whole words, leftmost and longest, without overlaps.

    texts: id (unique), text; phrases: phrase; both are compared in normal form, so signs, marks and case don't count. The dictionary's bytes are summed first:
    up to most_bytes it becomes an automaton in every task, beyond it is joined. Repeated phrases count once, empty ones never; null
    and empty texts have nothing; texts of any length are read whole.
    """
    plain = texts.select("id", F.coalesce(normalize_text("text"), F.lit("")).alias("text"))
    known = written(phrases.select(normalize_text("phrase").alias("phrase")).filter("phrase <> ''").distinct())
    size = known.agg(F.sum(F.octet_length("phrase")).alias("bytes"), F.max(F.size(F.split("phrase", " "))).alias("longest")).first()
    if (size["bytes"] or 0) <= most_bytes:
        hits = automaton_hits(plain, known)
    else:
        hits = joined_hits(plain, known, size["longest"])
    return hits.select("id", leftmost_longest(F.col("hits")).alias("found"))


def infer_titles(titles: DataFrame, names: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The titles (id, title) with year, brand, set_name, player, number, company, grade, parallel and sport, as far as they say so.

    names: kind (brand, set_name or player) and value: the catalog's own names. Names are found in one pass, the longest first; of each kind
    the first one counts, in the catalog's spelling (the least of several). number is the first of the title's codes. Titles without a
    year between 1900 and 2099 tell nothing and have usable false; so have those without player or number.
    """
    found = find_phrases(titles.select("id", F.col("title").alias("text")), names.select(F.col("value").alias("phrase")), most_bytes)
    spelled = names.select("kind", normalize_text("value").alias("phrase"), "value").filter("phrase <> ''").groupBy("kind", "phrase").agg(F.min("value").alias("value"))
    hits = found.select("id", F.explode("found").alias("h")).select("id", "h.start", "h.phrase").join(spelled, "phrase")
    first = hits.groupBy("id").agg(*[F.min(F.when(F.col("kind") == k, F.struct("start", "value")))["value"].alias(k) for k in ("brand", "set_name", "player")])
    t = F.coalesce("title", F.lit(""))
    plain = normalize_text(t)
    year = F.nullif(F.regexp_extract(t, r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")).cast("int")
    parallel = choose([*[(F.contains(plain, F.lit(w)), n) for w, n in PARALLELS.items()], (t.rlike(r"(?i)\brc\b"), "Rookie")], "Base")
    sport = choose([(F.contains(plain, F.lit(w)), n) for w, n in SPORTS.items()], "Sports Cards")
    out = titles.join(first, "id", "left").withColumns({"year": year, "number": F.get(card_numbers(t), F.lit(0)), "_g": title_grade(t), "parallel": parallel, "sport": sport})
    out = out.withColumns({"company": F.col("_g.company"), "grade": F.col("_g.grade")}).drop("_g")
    return out.withColumn("usable", F.col("year").isNotNull() & F.col("player").isNotNull() & F.col("number").isNotNull())
