"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.numbering import number_within
from cardloom.llm.text import text_or_empty
from cardloom.session import table

#: Fixed values of the published algorithm: the generator's multiplier and the range of its quotient.
MULTIPLIER = 2862933555777941757
QUOTIENT = float(1 << 31)


def jump_buckets(keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of each unsigned 64-bit key among 0 .. shards - 1.

    A key walks through the bucket counts at which it would move and stops at the last one below
    shards; the expected number of steps is the logarithm of shards.
    """
    state = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    target = np.zeros(len(state), np.int64)
    while len(moving):
        bucket[moving] = target
        state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = QUOTIENT / ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target = ((bucket[moving] + 1) * step).astype(np.int64)
        going = target < shards
        moving, target = moving[going], target[going]
    return bucket


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a key of any type; equal keys, null among them, share one.

    One more shard takes about 1 / (shards + 1) of the keys into itself and moves no other key.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf(T.IntegerType())
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return bucket(F.xxhash64(key))


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place documents into shards by their stable key: key, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1, slot counts the rows of a shard without gaps, and
    grown_shard is where the row would be with one more shard. A null text counts as an empty one.
    Rows with a null key share one shard. Repeated rows share a shard and have slots of their own.
    Other columns are dropped, so clashing names do no harm; an empty table gives an empty result.
    Texts are read once, hashed and left behind; only the narrow rows are written and numbered.
    """
    body = text_or_empty(text)
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    )
    return number_within(narrow, "shard", "slot").select(key, "size", "text_crc32", "shard", "slot", "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law that doc_id and the shard count decide."""
    placed = shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
