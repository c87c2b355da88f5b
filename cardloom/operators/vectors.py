"""Vectors and hashes: normalising, cosine search, Hamming pairs, groups of near duplicates, splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import let
from cardloom.session import written

#: Query vectors whose products with a block are held at a time, whatever the size of their own block.
LINES = 64


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column, length: int | None = None) -> Column:
    """The vector as doubles of length one; null for one of another length, with odd values or of norm zero."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    fine = fine & (F.size(vector) == length) if length is not None else fine
    # named once: inside the outer lambda the norm would be summed anew for each number
    scaled = lambda norm: F.when((norm > 0) & (norm < float("inf")), F.transform(doubles, lambda x: x / norm))
    return F.when(fine, let(F.sqrt(dot(doubles, doubles)), scaled))


def packed(rows: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """Rows of id (long) and v in blocks of at most size consecutive rows: ids and vectors as the bytes of longs and doubles.

    With by (long columns), rows are sorted by them and a block holds one value of each. Nothing is shuffled.
    """
    by = by or []
    kinds = pa.schema([*[(c, pa.int64()) for c in by], ("ids", pa.binary()), ("vectors", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in by]
            ids, vectors = batch.column("id").to_numpy(), batch.column("v")
            flat = vectors.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
            ends = np.ones(len(ids), bool)
            for key in keys:
                ends[:-1] &= key[1:] == key[:-1]
            starts = [0, *(np.flatnonzero(~ends[:-1]) + 1)] if keys and len(ids) else [0]
            out = []
            for start, stop in zip(starts, [*starts[1:], len(ids)], strict=True):
                out += [(*(int(k[at]) for k in keys), ids[at : min(at + size, stop)].tobytes(), flat[at : min(at + size, stop)].tobytes()) for at in range(start, stop, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], f.type) for f in kinds], schema=kinds)

    ready = rows.select(*by, F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    ready = ready.sortWithinPartitions(*by) if by else ready
    return ready.mapInArrow(pack, ", ".join([*[f"`{c}` bigint" for c in by], "ids binary, vectors binary"]))


def best_of_blocks(pairs: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, rank, id, similarity from pairs of blocks (q_ids, q_vectors, ids, vectors): each pair is one matrix product, and only its k best rows for a query leave the task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda column, at, kind: np.frombuffer(column[at].as_buffer(), kind)
        for batch in batches:
            for at in range(batch.num_rows):
                q_ids, ids = read(batch.column("q_ids"), at, np.int64), read(batch.column("ids"), at, np.int64)
                lines = read(batch.column("q_vectors"), at, np.float64).reshape(len(q_ids), -1)
                held, columns = read(batch.column("vectors"), at, np.float64).reshape(len(ids), -1).T, []
                for few in range(0, len(q_ids), LINES):
                    found = (lines[few : few + LINES] @ held).round(digits)
                    order = np.lexsort((np.broadcast_to(ids, found.shape), -found), axis=1)[:, :k]
                    columns.append((np.repeat(q_ids[few : few + LINES], order.shape[1]), ids[order].ravel(), np.take_along_axis(found, order, 1).ravel()))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["query_id", "id", "cosine"])

    scored = pairs.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(score, "query_id bigint, id bigint, cosine double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine")).alias("similarity"))


def named_as_queries(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})


def cosine_search(queries: DataFrame, rows: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """query_id, rank, id, similarity: the k rows of the highest cosine, clamped to 0 .. 1, for each stated query.

    Both tables have id and v, of unit length and one dimension. This is the exact search: every block of queries meets every block
    of rows once. Row blocks are dealt to as many places as there are blocks, up to four for each core, and
    query blocks are copied to each; only k rows of each query and block are shuffled.
    """
    held = written(packed(rows, 4096))
    deals = max(1, min(held.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = held.withColumn("_deal", F.pmod(F.xxhash64("ids"), F.lit(deals)))
    asked = named_as_queries(packed(queries, 512)).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    return best_of_blocks(asked.join(dealt, "_deal"), k, digits)


def joined_hashes(rows: DataFrame, by: str, hashed: str) -> DataFrame:
    """by and group_hash: the sha256 of each group's hashes, sorted and joined by '|', copies as often as they occur.

    Copies are counted in each task before the shuffle; a group's distinct hashes are one stream
    through one task, read in batches and never held whole.
    """
    counts = rows.filter(F.col(by).isNotNull()).groupBy(F.col(by), F.col(hashed).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.repartition(by).sortWithinPartitions(by, "_hash")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, lead = None, None, b""
        kind = None

        def made(names: list, hashes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(hashes, pa.string())], [by, "group_hash"])

        for batch in batches:
            kind, names, hashes = batch.column(0).type, [], []
            for name, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or name != now:
                    if digest is not None:
                        names.append(now)
                        hashes.append(digest.hexdigest())
                    now, digest, lead = name, hashlib.sha256(), b""
                if text is not None:
                    digest.update(lead + text.encode())
                    lead, again = b"|", b"|" + text.encode()
                    for at in range(1, n, 4096):
                        digest.update(again * min(4096, n - at))
            yield made(names, hashes)
        if digest is not None:
            yield made([now], [digest.hexdigest()])

    return dealt.mapInArrow(fold, f"`{by}` {rows.schema[by].dataType.simpleString()}, group_hash string")


def group_splits(rows: DataFrame, by: str, hashed: str, shares: tuple[int, int, int] = (70, 15, 15)) -> DataFrame:
    """Rows with group_hash and split: a group's split comes from the hash of its members' hashes in order, so it never straddles splits."""
    groups = joined_hashes(rows, by, hashed)
    bucket = F.conv(F.substring("group_hash", 1, 8), 16, 10).cast("long") % 100
    split = F.when(bucket < shares[0], "train").when(bucket < shares[0] + shares[1], "validation").otherwise("test")
    return rows.join(groups.withColumn("split", split), by)


def row_split(content: Column) -> Column:
    """80 / 10 / 10 by the hash of the content."""
    bucket = F.conv(F.substring(F.sha2(content, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes; 0 for boxes without area."""
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(0.0))
