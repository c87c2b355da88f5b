"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.text import text_or_empty
from cardloom.session import table, written

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes of a text that one call compresses, so that the dictionary weighs alike in texts of any length.
PIECE = 4096


def folded(text: str | None) -> bytes:
    """The letters of a text in lower case, other runs as one space; empty without letters."""
    kept = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return kept.encode("utf-8", "replace") if any(map(str.isalpha, kept)) else b""


def own_passages(texts: dict[str, list[list[bytes]]], width: int = 5) -> dict[str, list[list[bytes]]]:
    """The texts without the passages of width words and more that texts of another language hold too.

    Copied lines and texts of mixed languages would else speak for the language whose sample has them.
    """
    runs = lambda words: [b" ".join(words[at : at + width]) for at in range(len(words) - width + 1)]
    owners: dict[bytes, str | None] = {}
    for name, parts in texts.items():
        for run in {run for words in parts for run in runs(words)}:
            owners[run] = name if run not in owners else None
    out = {}
    for name, parts in texts.items():
        out[name] = []
        for words in parts:
            shared = {at + step for at, run in enumerate(runs(words)) if owners[run] is None for step in range(width)}
            out[name].append([word for at, word in enumerate(words) if at not in shared])
    return out


def dictionaries(rows: DataFrame, dict_bytes: int, max_bytes: int, rows_per_language: int, key: str, text: str, lang: str) -> dict[str, bytes]:
    """For each language, the most common first, the folded whole texts of its first rows by hash of the id, as many as fit.

    The sample is bounded: at most rows_per_language rows of a language, of dict_bytes together, or
    of an equal share of max_bytes where there are so many languages. Rows of more than a
    quarter of dict_bytes come last, so that a dictionary holds several texts; the first row is
    taken whatever its size. Only rows whose hash makes them likely to be among the first are put
    in order, so no language is brought together.
    """
    known = rows.filter(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), text_or_empty(text).alias("_text"))
    long = (F.octet_length("_text") > dict_bytes // 4).cast("int").alias("_long")
    narrow = known.select("_key", "_lang", long, F.xxhash64("_key").alias("_hash"))
    counts = narrow.groupBy("_lang", "_long").agg(F.count(F.lit(1)).alias("_n"))
    place = F.shiftrightunsigned("_hash", 1) / F.lit(float(1 << 63))
    likely = narrow.join(counts, ["_lang", "_long"]).filter(place * F.col("_n") < 4 * rows_per_language + 64)
    first = Window.partitionBy("_lang").orderBy("_long", "_hash", "_key")
    picked = likely.withColumn("_turn", F.row_number().over(first)).filter(F.col("_turn") <= rows_per_language).select("_key", "_lang", "_turn")
    # written, so that its size is known: texts move only if these ids are too many to send to every task
    sample = known.join(written(picked), ["_key", "_lang"]).groupBy("_lang", "_turn").agg(F.max("_text").alias("_text"))
    rows_of: dict[str, int] = {}
    for name, n in counts.groupBy("_lang").agg(F.sum("_n")).collect():
        rows_of[name] = n
    room = min(dict_bytes, max_bytes // max(len(rows_of), 1))
    texts: dict[str, list[list[bytes]]] = {}
    filled: Counter = Counter()
    for row in sample.orderBy("_lang", "_turn").toLocalIterator():
        name, letters = row["_lang"], folded(row["_text"])
        if letters and (not filled[name] or filled[name] + len(letters) < room):
            texts.setdefault(name, []).append(letters.split())
            filled[name] += len(letters) + 1
    found = {name: b"".join(b" ".join(words) + b" " for words in parts) for name, parts in own_passages(texts).items()}
    return {name: found[name] for name in sorted(found, key=lambda name: (-rows_of[name], name))}


class Compressors:
    """One compressor for each language, in the order of the dictionaries."""

    def __init__(self, contents: dict[str, bytes]):
        self.names = list(contents)
        self.compressors = []
        for name in self.names:
            content = contents[name]
            settings = zstandard.ZstdCompressionParameters.from_level(
                3, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0
            )
            dictionary = None
            if len(content) >= 8:
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))

    def sizes(self, letters: bytes) -> list[int]:
        """Compressed bytes of the whole text in each language.

        Every piece is given twice: the second time costs one match, and no piece is stored as it is.
        """
        pieces = [letters[at : at + PIECE] for at in range(0, len(letters), PIECE)]
        pieces = [p + b" " + p for p in pieces]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def guess(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest size, ties to the more common one, and by what share it is smaller than the next."""
        letters = folded(text)
        if not letters or not self.names:
            return UNDETERMINED, 0.0
        ranked = sorted((size, at) for at, size in enumerate(self.sizes(letters)))
        margin = 1.0 if len(ranked) == 1 else 1 - ranked[0][0] / ranked[1][0]
        return self.names[ranked[0][1]], margin


def identify(
    docs: DataFrame, training: DataFrame, min_margin: float = 0.002, dict_bytes: int = 1 << 17, max_bytes: int = 1 << 26, rows_per_language: int = 400,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The documents with lang_pred, margin, score and rejected.

    Each text's letters are compressed as a whole, in pieces, with a raw-content dictionary for
    every language of training; the smallest total wins. margin is the saving against the next
    language, score maps it to 0 .. 1 (0.5 at min_margin), and rejected marks margins below
    min_margin and texts without letters. A null or letter-free text is und with score 0, as is
    every text when training has no labels. Ties go to the language with more labelled rows, with margin 0. Repeated rows
    get equal results; other columns stay but for those named like the added ones. An empty table
    gives an empty result. The dictionaries, at most max_bytes and one text for each language, go to
    the tasks with the code; each task reads its own texts and nothing is shuffled. Rows of training without
    an id or a language teach nothing, nor do texts without letters; of texts that share an id and a
    language the largest counts.
    """
    added = ["lang_pred", "margin", "score", "rejected"]
    contents = dictionaries(training, dict_bytes, max_bytes, rows_per_language, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    @F.pandas_udf("lang_pred string, margin double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(shared.value)
        for batch in batches:
            yield pd.DataFrame([compressors.guess(x) for x in batch], columns=["lang_pred", "margin"])

    guessed = docs.drop(*added).withColumn("_guess", guess(F.col(text).cast("string"))).select("*", "_guess.*").drop("_guess")
    score = F.col("margin") / (F.col("margin") + F.lit(min_margin))
    rejected = (F.col("lang_pred") == UNDETERMINED) | (F.col("margin") < min_margin)
    return guessed.withColumn("score", score).withColumn("rejected", rejected)


def id_remainder(key: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; the folds of the labelled operators."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    found = identify(docs.drop("lang"), docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
