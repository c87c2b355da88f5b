"""Queries on hashes of texts, duplicate groups, their splits, verified matches and physical items."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import evaluation as E
from cardloom.operators import hashes as H
from cardloom.operators import physical as P
from cardloom.operators import vectors as V
from cardloom.session import spread, table, written

#: Bits of 256 in which near duplicates differ at most, and of 64 in which a match worth verifying does.
NEAR, PREFILTER = 6, 16
#: Words below which a text has no hash, as too few cells of its grid are filled.
LEAST_WORDS = 32
ACCEPTED = 0.5
#: Words whose cells a task keeps.
MOST_WORDS = 50_000


def grid_hash(text: Column, words: int) -> Column:
    """The difference hash of a text: its words counted in 64 * words + 1 cells, each cell compared with the next; null below LEAST_WORDS words."""
    cells = 64 * words + 1

    @F.pandas_udf("array<bigint>")
    def hashed(texts: pd.Series) -> pd.Series:
        cell_of: dict[bytes, int] = {}  # texts share most of their words

        def one(text: str | None) -> list[int] | None:
            parts = (text or "").encode().split()
            if len(parts) < LEAST_WORDS:
                return None
            for w in set(parts).difference(cell_of):
                cell_of[w] = int.from_bytes(hashlib.md5(w).digest()[:8], "little") % cells
            counts = np.bincount([cell_of[w] for w in parts], minlength=cells)
            if len(cell_of) > MOST_WORDS:
                cell_of.clear()
            return H.pack_bits(counts[:-1] > counts[1:])

        return texts.map(one)

    return hashed(text)


def hashed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), grid_hash(F.col("text"), 4).alias("hash"))


def hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within six of 256 bits between the first documents of each hash, and the others of each hash."""
    return H.near_links(hashed_texts(spark, sf_dir), NEAR, 4)


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by hashes at most six of 256 bits apart."""
    return H.near_groups(hashed_texts(spark, sf_dir), NEAR, 4)


def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of documents by the hashes of their duplicate group, so near copies stay together, and by row."""
    groups = duplicate_groups(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("group").alias("family"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")).join(groups, "doc_id")
    return V.group_splits(docs, "family", "content").select("doc_id", "family", "split", V.row_split(F.col("content")).alias("row_split"))


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that splitting by row spreads over splits."""
    return E.leaking_groups(split_assignment(spark, sf_dir), "family", "row_split")


def word_numbers(words: list[bytes], number_of: dict[bytes, int]) -> np.ndarray:
    """A number of 64 bits for each word, the one whose remainder is its cell; number_of keeps those of earlier words."""
    for w in set(words).difference(number_of):
        number_of[w] = int.from_bytes(hashlib.md5(w).digest()[:8], "little")
    found = np.array([number_of[w] for w in words], np.uint64)
    if len(number_of) > MOST_WORDS:
        number_of.clear()
    return found


def match_facts(text: Column, plain: Column) -> Column:
    """Of a text and its lower-cased form: the hashes of both as grid_hash takes them at 64 bits, and how many distinct words the second has and the parities of these."""

    @F.pandas_udf("hash array<bigint>, plain_hash array<bigint>, size int, parities array<bigint>")
    def facts(texts: pd.Series, plains: pd.Series) -> pd.DataFrame:
        number_of: dict[bytes, int] = {}

        def hashed(numbers: np.ndarray) -> list[int] | None:
            if len(numbers) < LEAST_WORDS:
                return None
            counts = np.bincount((numbers % np.uint64(65)).astype(np.int64), minlength=65)
            return H.pack_bits(counts[:-1] > counts[1:])

        def one(text: str | None, lower: str | None) -> tuple:
            words, plain_words = (text or "").encode().split(), (lower or "").encode().split()
            numbers = word_numbers(plain_words, number_of)
            held = np.unique(numbers)
            own = numbers if words == plain_words else word_numbers(words, number_of)
            return hashed(own), hashed(numbers), len(held), H.pack_bits(H.parity_bits(held))

        return pd.DataFrame([one(*both) for both in zip(texts, plains, strict=True)], columns=["hash", "plain_hash", "size", "parities"])

    return facts(text, plain)


def word_set(plain: Column) -> Column:
    """The numbers of the distinct words of a lower-cased text."""

    @F.pandas_udf("array<bigint>")
    def numbered(plains: pd.Series) -> pd.Series:
        number_of: dict[bytes, int] = {}
        return plains.map(lambda lower: np.unique(word_numbers((lower or "").encode().split(), number_of)).view(np.int64))

    return numbered(plain)


def reference_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of every document whose id is divisible by 20 among all others.

    Equal texts match outright; else documents within 16 of 64 bits of the hash of the text or of its lower-cased form are compared by their words.
    """
    plain = F.lower(F.coalesce("text", F.lit("")))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = written(texts.select("id", F.md5(F.nullif("text", F.lit(""))).alias("content"), match_facts("text", plain).alias("facts")).select("id", "content", "facts.*"))
    shared = F.size(F.array_intersect("left", "right"))
    score = shared / (F.size("left") + F.size("right") - shared)
    words_of = lambda ids: texts.join(ids, "id", "left_semi").select("id", word_set(plain).alias("evidence"))
    found = H.verified_matches(docs.filter("id % 20 = 0"), docs.filter("id % 20 <> 0"), PREFILTER, 1, score, score >= ACCEPTED, ACCEPTED, words_of)
    return found.select("query_id", "id", "method", F.round("score", 6).alias("score"))


def item_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as photos of items: texts are their content, and hashes of parts of them what is read off and seen."""
    docs = table(spark, sf_dir, "documents")
    told = F.md5(F.coalesce("text", F.lit("")))
    digit = lambda at, n: F.conv(F.substring(told, at, 4), 16, 10).cast("int") % n
    noise = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), F.pmod("doc_id", F.lit(8)).cast("int") + 1).cast("long")
    seen = F.xxhash64("lang", (F.col("n_chars") / 400).cast("int"))
    return docs.select(
        F.col("doc_id").alias("id"),
        told.alias("content_hash"),
        F.when(F.col("doc_id") % 5 != 0, seen.bitwiseXOR(noise)).alias("fingerprint"),
        F.when(F.col("doc_id") % 6 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 45)).alias("captured_at"),
        P.identity_of([F.col("lang"), F.col("source"), digit(1, 12)], F.when(digit(5, 5) > 0, digit(5, 3)), F.lit(None)).alias("identity"),
        (F.lit(0.8) + F.col("doc_id") % 5 * 0.05).alias("identity_confidence"),
        F.element_at(F.array(*map(F.lit, ["front", "back", "front", "back", "unknown"])), F.pmod("doc_id", F.lit(5)).cast("int") + 1).alias("side"),
        F.when(digit(9, 9) == 0, F.concat(F.lit("c"), digit(13, 40).cast("string"))).alias("cert"),
        P.unique_serial(F.when(digit(17, 4) == 0, F.concat(F.lit("no. "), digit(21, 30).cast("string"), F.lit(" / 99")))).alias("serial"),
    )


def physical_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The physical item of every document's view, and the evidence that places it there."""
    return P.physical_items(item_views(spark, sf_dir))


def lot_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of each physical item with the surest identity, the least id of several, and its views by side."""
    views = item_views(spark, sf_dir).select("id", F.coalesce("identity_confidence", F.lit(0.0)).alias("confidence"), "side")
    placed = physical_items(spark, sf_dir).select("id", "group").join(spread(views), "id")
    best = F.max_by("id", F.struct("confidence", (-F.col("id")).alias("least")))
    return placed.groupBy("group").agg(best.alias("id"), F.round(F.max("confidence"), 4).alias("confidence"), F.count(F.lit(1)).alias("views"), F.count_if(F.col("side") == "front").alias("fronts"), F.count_if(F.col("side") == "back").alias("backs"))


QUERIES = {f.__name__: f for f in (hamming_neighbours, duplicate_groups, split_assignment, split_leakage, reference_matches, physical_items, lot_representatives)}


def _bits_sql(words: int, text: str) -> str:
    """SQL of the hash of a text as letters 0 and 1, null where it has too few words."""
    cells = 64 * words + 1
    parts = rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
    return f"""CASE WHEN len({parts}) >= {LEAST_WORDS} THEN (SELECT list_aggregate(list_transform(range({cells - 1}), lambda i: CASE WHEN coalesce(c[i], 0) > coalesce(c[i + 1], 0) THEN '1' ELSE '0' END), 'string_agg', '')
        FROM (SELECT map_from_entries(list((cell, n))) AS c FROM (SELECT (md5_number_upper(w) % {cells})::BIGINT AS cell, count(*) AS n FROM (SELECT unnest({parts}) AS w) GROUP BY 1))) END"""


_NEAR_SQL = f"""h AS MATERIALIZED (SELECT doc_id AS id, {_bits_sql(4, "coalesce(text, '')")} AS hash FROM documents
), reps AS (SELECT hash, min(id) AS id FROM h WHERE hash IS NOT NULL GROUP BY hash
), near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, hamming(a.hash, b.hash) AS distance FROM reps a JOIN reps b ON a.id < b.id AND hamming(a.hash, b.hash) <= {NEAR})"""

_GROUPS_SQL = f"""{_NEAR_SQL}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near
), r AS (SELECT id, id AS reach FROM reps UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a
), g AS (SELECT id, min(reach) AS "group" FROM r GROUP BY id
), grouped AS (SELECT h.id, coalesce(g."group", h.id) AS "group", coalesce((SELECT count(*) FROM e WHERE e.a = reps.id), 0) AS links FROM h LEFT JOIN reps ON h.hash = reps.hash LEFT JOIN g ON g.id = reps.id)"""

_SPLITS_SQL = f"""{_GROUPS_SQL}, d AS (SELECT doc_id, "group" AS family, sha256(coalesce(text, '')) AS content FROM documents JOIN grouped ON id = doc_id
), f AS (SELECT family, ('0x' || substr(sha256(string_agg(content, '|' ORDER BY content)), 1, 8))::BIGINT % 100 AS bucket FROM d GROUP BY family
), splits AS (SELECT doc_id, family, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'validation' ELSE 'test' END AS split,
    CASE WHEN ('0x' || substr(sha256(content), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(sha256(content), 1, 8))::BIGINT % 100 < 90 THEN 'validation' ELSE 'test' END AS row_split FROM d JOIN f USING (family))"""

ORACLES = {
    "hamming_neighbours": f"WITH {_NEAR_SQL} SELECT a, b, distance FROM near UNION ALL SELECT reps.id, h.id, 0 FROM h JOIN reps USING (hash) WHERE h.id <> reps.id",
    "duplicate_groups": f'WITH RECURSIVE {_GROUPS_SQL} SELECT id, "group", links FROM grouped',
    "split_assignment": f"WITH RECURSIVE {_SPLITS_SQL} SELECT doc_id, family, split, row_split FROM splits",
    "split_leakage": f'WITH RECURSIVE {_SPLITS_SQL} SELECT family, count(DISTINCT row_split) AS splits, count(*) AS "rows" FROM splits GROUP BY family HAVING count(DISTINCT row_split) > 1',
    "reference_matches": rf"""WITH d AS MATERIALIZED (SELECT doc_id AS id, nullif(text, '') AS content, {_bits_sql(1, "coalesce(text, '')")} AS hash, {_bits_sql(1, "lower(coalesce(text, ''))")} AS plain,
        list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')) AS words FROM documents
      ), exact AS (SELECT q.id AS query_id, min(r.id) AS id, 'exact_content' AS method, 1.0::DOUBLE AS score FROM d q JOIN d r ON q.content = r.content AND q.id % 20 = 0 AND r.id % 20 <> 0 GROUP BY q.id
      ), near AS (SELECT q.id AS query_id, r.id, len(list_intersect(q.words, r.words)) AS shared, len(q.words) + len(r.words) AS total FROM d q JOIN d r ON q.id % 20 = 0 AND r.id % 20 <> 0
          AND least(hamming(q.hash, r.hash), hamming(q.plain, r.hash)) <= {PREFILTER} WHERE q.id NOT IN (SELECT query_id FROM exact)
      ), judged AS (SELECT query_id, id, shared / (total - shared) AS score FROM near WHERE shared / (total - shared) >= {ACCEPTED}
      ), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM judged)
      SELECT * FROM exact UNION ALL SELECT query_id, id, 'verified', round(score, 6) FROM best WHERE place = 1""",
}
