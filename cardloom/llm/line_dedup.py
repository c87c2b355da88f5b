"""Corpus-wide line dedup that yields keep bitmaps instead of texts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.text import SPACE, lines_of, lower_ascii, text_or_empty
from cardloom.session import table, written

#: Lines to a word of a bitmap.
BITS = 64


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def wide_hash(*values: Column) -> list[Column]:
    """Two 64-bit hashes with independent seeds, together a 128-bit one."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def row_id(key: str, text: str) -> Column:
    """128 bits that tell a row's document and text; copies of a row share them, as they share a result."""
    first, second = wide_hash(F.col(key), text_or_empty(text))
    return F.struct(first.alias("a"), second.alias("b"))


def hashed_lines(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """_a, _b, _doc, _turn, _row, _at: every line whose key has at least min_chars code points, as the hash of its key; _turn numbers the rows of docs."""
    rows = docs.select(F.col(key).alias("_doc"), F.monotonically_increasing_id().alias("_turn"), row_id(key, text).alias("_row"), F.col(text).alias("_text"))
    lines = rows.select("_doc", "_turn", "_row", F.posexplode(lines_of(text_or_empty("_text"))).alias("_at", "_line"))
    keyed = lines.select("_doc", "_turn", "_row", "_at", line_key(F.col("_line")).alias("_key")).filter(F.char_length("_key") >= min_chars)
    first, second = wide_hash(F.col("_key"))
    return keyed.select(first.alias("_a"), second.alias("_b"), "_doc", "_turn", "_row", "_at")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, keep: the compressed keep bitmap of every row that loses a line, a map from word index to 64 bits.

    Bit i of word w stands for line 64 w + i and is set where the line stays; words that are not in
    the map keep all their lines, and rows that are not in the result keep everything.

    The hashes of all lines are made in one pass and range-partitioned with a secondary sort by
    descending document and position, so that a line that a third of all documents hold fills
    many ranges and its first occurrence is the first row of the first of them. A range's stream
    gives one row for each of its hashes: the first document and the number of documents. These
    rows are carried over to the other ranges of the hash; only they meet, not the lines. Lines find the
    verdict on their hash within their own range.
    """
    order = ["_a", "_b", F.col("_doc").desc_nulls_last(), "_turn"]
    lines = written(hashed_lines(docs, min_chars, key, text))
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, "_at")
    placed = written(ranged.withColumn("_range", F.spark_partition_id()))

    held = placed.groupBy("_range", "_a", "_b", "_turn").agg(F.max("_doc").alias("_doc"))
    runs = written(held.groupBy("_range", "_a", "_b").agg(F.max("_doc").alias("_first"), F.count(F.lit(1)).alias("_docs")))
    hashes = runs.groupBy("_a", "_b").agg(F.max("_first").alias("_first"), F.sum("_docs").alias("_docs")).filter(F.col("_docs") >= min_docs).drop("_docs")
    carried = runs.select("_range", "_a", "_b").join(hashes, ["_a", "_b"])
    repeats = placed.join(written(carried), ["_range", "_a", "_b"]).filter(~F.col("_doc").eqNullSafe(F.col("_first")))

    words = repeats.groupBy("_row", F.floor(F.col("_at") / BITS).cast("int").alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, _at % {BITS})")).alias("_drops"))
    return words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_word", F.bitwise_not("_drops")))).alias("keep"))


def is_kept(keep: Column, at: Column) -> Column:
    """Whether the bitmap keeps the line at a position."""
    word = F.element_at(keep, F.floor(at / BITS).cast("int"))
    return F.coalesce(F.getbit(word, F.pmod(at, F.lit(BITS))) == 1, F.lit(True))


def n_dropped(keep: Column) -> Column:
    """How many lines a bitmap drops; null drops none."""
    return F.coalesce(F.aggregate(F.map_values(keep), F.lit(0), lambda n, bits: n + F.bit_count(F.bitwise_not(bits))), F.lit(0)).cast("long")


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with n_lines, n_dropped and keep added: see keep_bitmaps. keep is null where no line goes.

    A line's key has white space stripped at both ends and A-Z lower-cased. A key of at least
    min_chars code points that at least min_docs rows hold loses all its lines but those in the
    largest document id that holds it; a null id counts as the smallest. A null or empty text has
    one empty line. Repeated rows count as documents of their own; those that share the largest id
    all keep the line. Columns named like the added ones are replaced. An
    empty table gives an empty result.
    """
    plain = docs.drop("n_lines", "n_dropped", "keep").withColumn("_row", row_id(key, text))
    marked = plain.join(keep_bitmaps(docs, min_chars, min_docs, key, text), "_row", "left").drop("_row")
    return marked.withColumn("n_lines", F.size(lines_of(text_or_empty(text))).cast("long")).withColumn("n_dropped", n_dropped(F.col("keep")))


def kept_text(text: str, keep: str = "keep") -> Column:
    """The lines that a bitmap keeps, joined by line feeds; the whole text where it is null."""
    kept = F.filter(lines_of(text_or_empty(text)), lambda _, at: is_kept(F.col(keep), at))
    return F.when(F.col(keep).isNull(), text_or_empty(text)).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text added; rules and hard rows as in line_bitmaps."""
    return line_bitmaps(docs.drop("kept_text"), min_chars, min_docs, key, text).withColumn("kept_text", kept_text(text)).drop("keep")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from all documents, and the hash of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_bitmaps(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text("text"), 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {
    "op5_line_dedup": r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, max(doc_id) AS first_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3
), judged AS (
  SELECT a.*, f.k IS NOT NULL AND a.doc_id IS DISTINCT FROM f.first_doc AS drops
  FROM keyed a LEFT JOIN firsts f ON a.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE drops)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""
}
