"""A training corpus from documents: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from fractions import Fraction
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.language_id import identify
from cardloom.llm.line_dedup import dedup_lines
from cardloom.llm.mixing import mixed_texts, row_id
from cardloom.llm.near_dedup import near_duplicates
from cardloom.llm.packing import pack
from cardloom.session import discard_tables, table, written

#: SQL has no compression, minhash or tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def with_lengths(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those with a null, empty or letter-free text or a narrow margin go.

    Long texts count as a whole, equal texts share a verdict (ties of sizes have margin 0 and go),
    repeated rows stay or go together, and an empty table gives an empty one.
    """
    return identify(docs, docs).filter(~F.col("rejected")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share; the largest id keeps each.

    Every row stays, with a text of "" where it was null or lost all lines, and its new length in
    n_chars. Null ids count as the smallest, repeated rows as documents of their own; rows that
    share the largest id all keep the line.
    """
    deduped = dedup_lines(docs).withColumn("text", F.col("kept_text")).select(docs.columns)
    return with_lengths(deduped)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at 0.8 of their 5-word shingles: the first by id, then by the other columns; null ids come last.

    Rows are linked by text alone, so those that share an id or have none are rows like others.
    Rows without words stay, one of those that share id and text: null and empty texts are one.
    Texts of fewer than five words are one shingle. An empty table gives an empty one.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = near_duplicates(rows.select("_row", "text"), width=5, threshold=Fraction(4, 5), key="_row").select("_row", "n_shingles", "component_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    narrow = rows.select("_row", "doc_id", row_id("text").alias("_text"), *others).join(found, "_row")
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless, F.col("component_id")).alias("_component"), F.when(wordless, F.col("doc_id")).alias("_id"), F.when(wordless, F.col("_text")).alias("_same")]
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *others, "_text", "_row")
    first = narrow.groupBy(*group).agg(F.min(order).alias("_first")).select("_first._row")
    return rows.join(written(first), "_row", "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources meet the weights 1, 2, 3, none above three epochs.

    Rows without words are never taken and go. A null source is the last one. Rows equal in id,
    text and source are repeated together; the order of documents is that of a seeded hash, so reruns agree.
    """
    return with_lengths(mixed_texts(docs, weights=(1, 2, 3), max_epochs=3))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null text counts as empty; rows with a null id and repeated rows are packed like others. An
    empty table gives no pieces.
    """
    return pack(docs.select("doc_id", "text"), window=2048)


def after_the_last(stage):
    """The stage, with the tables of the stages before it discarded, as docs has all that they kept; tables that docs reads stay."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_tables(docs)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, after_the_last(stage)) for stage in (language_id, line_dedup, near_dedup, mixing, packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if at == len(STAGES) - 1 else written(docs)
    return docs
