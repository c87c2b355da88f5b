"""Near-duplicate documents: MinHash banding, signature and exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.components import components
from cardloom.llm.shingles import U64, Bands, Shingler, set_fingerprint
from cardloom.session import discard_tables, table, written, written_so_far

#: Rows, and shingles in them, of one side of a comparison within a bucket.
SIDE_ROWS, SIDE_SHINGLES = 512, 1 << 19
#: Shingles that a block comparison takes at once.
COLUMNS = 2048


def is_linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Whether shared / union >= threshold, in integers."""
    return threshold.denominator * shared >= threshold.numerator * (left + right - shared)


def signed(docs: DataFrame, key: str, text: str, width: int, bands: Bands) -> DataFrame:
    """doc, n, fp1, fp2, keys, sig: set size, set fingerprint, bucket keys, and 16 bits of every minimum."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, functions = Shingler(width), bands.functions()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for text in part.column(1):
                    shingles = shingler.shingles(text.as_py())
                    signature = bands.signature(shingles, functions)
                    some = len(shingles) > 0
                    rows.append((len(shingles), *set_fingerprint(shingles), bands.keys(signature) if some else [], signature.astype(np.uint16).tobytes() if some else b""))
                n, fp1, fp2, keys, sig = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    ["doc", "n", "fp1", "fp2", "keys", "sig"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(sign, "doc bigint, n bigint, fp1 bigint, fp2 bigint, keys array<bigint>, sig binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc, set: the whole shingle set of each document in ids, 8 bytes a shingle."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingler.shingles(x.as_py()).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc", "set"])

    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").cast("binary").alias("text"))
    return source.join(ids, "doc", "left_semi").mapInArrow(build, "doc bigint, set binary")


def agreement(left: str, right: str) -> Column:
    """Share of equal minima of two signatures."""

    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))) for x, y in zip(a, b, strict=True)], dtype="float64")

    return agree(left, right)


def linked(left: str, right: str, threshold: Fraction) -> Column:
    """Whether two whole sets are linked."""

    @F.pandas_udf("boolean")
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            out.append(bool(is_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)))
        return pd.Series(out, dtype="bool")

    return link(left, right)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    lengths = [len(x) for x in left], [len(x) for x in right]
    sides = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(common, side) for side in sides]
    held = [(a < len(common)) & (common[np.minimum(a, len(common) - 1)] == side) if len(common) else np.zeros(len(a), bool) for a, side in zip(at, sides, strict=True)]
    rows = [np.repeat(np.arange(len(x)), x)[h] for x, h in zip(lengths, held, strict=True)]
    at = [a[h] for a, h in zip(at, held, strict=True)]
    for begin in range(0, len(common), COLUMNS):
        parts = []
        for a, r, n in zip(at, rows, map(len, lengths), strict=True):
            inside = (a >= begin) & (a < begin + COLUMNS)
            part = np.zeros((n, min(COLUMNS, len(common) - begin)), np.float32)
            part[r[inside], a[inside] - begin] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def link_block(group: pa.Table, threshold: Fraction) -> pa.Table:
    """The links between the left and the right rows of one comparison whose components differ; one link for each pair of components."""
    side = group["left"].to_numpy(zero_copy_only=False)
    names, comp = np.unique(group["comp"].to_numpy(), return_inverse=True)
    column = group["set"].combine_chunks()
    sets = [np.frombuffer(x.as_buffer(), U64) for x in column]
    a, b = np.flatnonzero(side), np.flatnonzero(~side)
    codes = np.empty(0, np.int64)
    if len(a) and len(b):
        shared = shared_counts([sets[i] for i in a], [sets[i] for i in b])
        sizes = np.array([len(x) for x in sets])
        for at, row in enumerate(shared):
            near = b[is_linked(row, sizes[a[at]], sizes[b], threshold)]
            ends = np.unique(comp[near])
            ends = ends[ends != comp[a[at]]]
            codes = np.union1d(codes, np.minimum(ends, comp[a[at]]) * len(names) + np.maximum(ends, comp[a[at]]))
    return pa.table({"a": pa.array(names[codes // max(len(names), 1)], pa.int64()), "b": pa.array(names[codes % max(len(names), 1)], pa.int64())})


def links_in_buckets(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b: links between different components within the buckets, all of them.

    A bucket's largest component holds most of its rows. Every row outside it is compared with every
    row of the bucket: both sides are dealt by hash to chunks of bounded rows and shingles, and each
    pair of chunks is one comparison. Buckets of a single component have nothing to compare.
    """
    labelled = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component", "center")
    labelled = written(labelled)
    counts = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    stats = counts.groupBy("key").agg(
        F.count(F.lit(1)).alias("comps"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"),
        F.max(F.struct("rows", F.col("comp").alias("c"), "shingles")).alias("top"),
    )
    chunks = lambda rows, shingles: F.greatest(F.lit(1), F.ceil(rows / SIDE_ROWS), F.ceil(shingles / SIDE_SHINGLES)).cast("int")
    mixed = written(
        stats.filter("comps > 1").select(
            "key", F.col("top.c").alias("largest"), chunks(F.col("rows"), F.col("shingles")).alias("rights"),
            chunks(F.col("rows") - F.col("top.rows"), F.col("shingles") - F.col("top.shingles")).alias("lefts"),
        )
    )
    open_rows = written(labelled.join(mixed, "key"))
    turn = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = open_rows.select("key", "doc", "comp", turn(1, "rights").alias("j"), span("lefts").alias("i"), F.lit(False).alias("left"))
    left = open_rows.filter("comp <> largest").select("key", "doc", "comp", turn(2, "lefts").alias("i"), span("rights").alias("j"), F.lit(True).alias("left"))
    dealt = left.unionByName(right).join(sets, "doc").select("key", "i", "j", "left", "doc", "comp", "set")
    return dealt.groupBy("key", "i", "j").applyInArrow(lambda group: link_block(group, threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float | Fraction = Fraction(4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept: components of documents linked by the Jaccard similarity of their word shingles.

    Words are parts between ASCII white space with A-Z lower-cased; a text with fewer words than
    width is one shingle. Documents without words have size 0 and stand alone, as do rows with a
    null id (component_id null, kept). kept marks the smallest id of each component. Rows that share an
    id are one node: each has its own size, and they share a component. Equal sets are one class
    however many documents hold them. Other columns are not read; an empty table gives no rows.

    One pass over the texts keeps narrow rows: size, fingerprint, bucket keys, signature. Classes
    of equal sets leave one representative each. The number of bands makes a pair at the threshold
    miss all buckets with a probability of at most 1e-6. Every representative is first compared
    with the least member that it shares most buckets with, by signature (six standard deviations
    below the threshold are let through), then by whole sets; that joins large groups by stars
    instead of pairs. What is then in the same bucket but in different components is compared
    exactly, all of it. Components come from alternating large-star and small-star.
    """
    threshold = Fraction(threshold).limit_denominator(1000)
    bands = Bands.for_threshold(float(threshold))
    before = written_so_far()
    every = written(signed(docs, key, text, width, bands))
    full = every.filter((F.col("n") > 0) & F.col("doc").isNotNull())
    classes = written(full.groupBy("fp1", "fp2").agg(F.min("doc").alias("rep")))
    chosen = full.join(classes, ["fp1", "fp2"]).filter(F.col("doc") == F.col("rep"))
    reps = written(chosen.select("doc", "n", "keys", "sig").dropDuplicates(["doc", "n", "sig"]))

    placed = reps.select("doc", "n", F.explode("keys").alias("key"))
    buckets = written(placed.groupBy("key").agg(F.min("doc").alias("center"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    members = written(placed.join(buckets, "key"))

    best = members.filter("doc <> center").groupBy("doc", "center").count().groupBy("doc").agg(F.max(F.struct("count", (-F.col("center")).alias("c"))).alias("_best"))
    edges = best.select("doc", (-F.col("_best.c")).alias("center"))
    signatures = reps.select("doc", "sig")
    near = edges.join(signatures, "doc").join(signatures.select(F.col("doc").alias("center"), F.col("sig").alias("sig_c")), "center")
    let_through = float(threshold) - 6 * float(np.sqrt(float(threshold) * (1 - float(threshold)) / bands.hashes))
    near = written(near.filter(agreement("sig", "sig_c") >= let_through).select("doc", "center").distinct())
    discard_tables(every, classes, members, near, before=before)

    sets = written(shingle_sets(docs, written(members.select("doc").distinct()), key, text, width))
    pairs = near.join(sets, "doc").join(sets.select(F.col("doc").alias("center"), F.col("set").alias("set_c")), "center")
    stars = pairs.filter(linked("set", "set_c", threshold)).select("doc", "center")
    labels = written(components(stars, "doc", "center"))
    more = written(links_in_buckets(members, labels, sets, threshold))
    discard_tables(every, classes, labels, more, before=before)
    merged = components(more).withColumnRenamed("component", "_final")
    named = labels.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("_final", "component").alias("component"))
    alone = merged.join(labels, "node", "left_anti").select("node", F.col("_final").alias("component"))
    final = written(named.union(alone).withColumnRenamed("node", "rep"))
    discard_tables(every, classes, final, before=before)

    joined = every.select("doc", "n", "fp1", "fp2").join(classes, ["fp1", "fp2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc")))
    out = joined.join(final, "rep", "left").withColumn("component", F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc")))
    return out.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept")
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at a similarity of 0.85 of their sets of 3-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, threshold=Fraction(85, 100))


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES: dict[str, str] = {}
