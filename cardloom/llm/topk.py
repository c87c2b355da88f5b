"""Exact top-k by inner product, block at a time, with bounds from term maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.session import cut, table

LOWEST = np.iinfo(np.int64).min
#: Doubles hold integers up to here exactly.
EXACT = float(1 << 53)
#: Parts into which the ranges' bounds are dealt to meet the blocks of queries.
DEALS = 64


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def dense(column: pa.Array) -> np.ndarray:
    """A matrix of integer lists; shorter lists are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left times right transposed, as exact integers; the fast multiplication of doubles where it is exact."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(width, 1)
    if largest < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
    """The k best (-score, id) at or above floor; ids ascend."""
    if len(scores) > k:
        floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    above = np.flatnonzero(scores > floor)
    even = np.flatnonzero((scores == floor) & (scores > LOWEST))[:k]
    at = np.concatenate([above, even])
    return sorted(zip((-scores[at]).tolist(), ids[at].tolist(), strict=True))[:k]


def block_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, the sum over terms of the largest product in the block."""
    return product(np.maximum(queries, 0), high) + product(np.minimum(queries, 0), low)


class Group:
    """A range of documents as forward-index blocks with the least and largest value of each term in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int):
        self.blocks = []
        for at in range(0, len(ids), block):
            order = np.argsort(ids[at : at + block], kind="stable")
            self.blocks.append((ids[at : at + block][order], vectors[at : at + block][order]))
        self.high = np.array([v.max(axis=0) for _, v in self.blocks])
        self.low = np.array([v.min(axis=0) for _, v in self.blocks])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block, the sum over terms of the largest product in the block."""
        return block_bounds(queries, self.high, self.low)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        """The best of this group for each query, as (-score, id); scores below a query's floor may be left out.

        Each query visits blocks by falling bound and stops when the next bound is below its kth
        score. A round takes every query's next block and scores queries at the same block together.
        """
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        found: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        floors = floors.copy()
        live = np.arange(len(query_ids))
        for turn in range(len(self.blocks)):
            block = order[live, turn]
            going = bounds[live, block] >= floors[live]
            live, block = live[going], block[going]
            if not len(live):
                break
            for b in np.unique(block):
                ids, vectors = self.blocks[b]
                rows = live[block == b]
                scores = product(queries[rows], vectors)
                scores[query_ids[rows][:, None] == ids[None, :]] = LOWEST
                for row, line in zip(rows, scores, strict=True):
                    new = best_of(line, ids, k, int(floors[row]))
                    if new:
                        found[row] = sorted(found[row] + new)[:k]
                        if len(found[row]) == k:
                            floors[row] = max(floors[row], -found[row][-1][0])
        return found


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, group_size: int = 4096, block: int = 256, query_block: int = 1024, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k largest integer inner products over all other rows.

    Components are scaled and floored; ties go to the smaller id. Rows with a null id, a null
    vector or a null or non-finite component take no part; vectors of other lengths count as filled
    with zeros, and an empty vector scores 0. Repeated rows are candidates each; of query rows that
    share an id one answers (the least vector), and no row with a query's own id is its candidate.
    A table with fewer rows gives fewer ranks, an empty one none. Other columns are not read.
    Scores must fit a long.

    Rows are ordered by the term with the largest value, then id, and cut into ranges: a task holds
    group_size vectors as forward-index blocks with each term's least and largest value. A query
    first searches its own range, which gives it a lower bound of its kth score. Blocks of queries
    then meet the bounds of every range; a query goes on to the ranges whose bound reaches its
    kth score, and only these are joined with their vectors and visit blocks by falling bound.
    Queries against all rows are quadratic work by the request; what is shuffled for a query and
    range is at most the query and k rows.
    """
    valid = rows.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    valid = valid.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"), is_query.alias("is_query"))
    n_groups = max(1, -(-valid.count() // group_size))
    leading = F.coalesce(F.array_position("v", F.array_max("v")), F.lit(0))
    dealt = valid.withColumn("_leading", leading).repartitionByRange(n_groups, "_leading", "id").sortWithinPartitions("_leading", "id").drop("_leading")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts)
            ids, vectors, asks = whole["id"].to_numpy(), dense(whole["v"]), whole["is_query"].fill_null(False).to_numpy()
            group = Group(ids, vectors, block)
            found = group.search(ids[asks], vectors[asks], k, np.full(int(asks.sum()), LOWEST))
            floors = np.full(len(ids), LOWEST)
            floors[asks] = [-best[-1][0] if len(best) == k else LOWEST for best in found]
            return pa.RecordBatch.from_pydict(
                {
                    "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "width": [vectors.shape[1]],
                    "high": [group.high.tobytes()], "low": [group.low.tobytes()],
                    "queries": [[{"id": int(ids[i]), "v": vectors[i].tolist(), "floor": int(floors[i])} for i in np.flatnonzero(asks)]],
                },
                schema=built,
            )

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, group_size - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == group_size:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    built = pa.schema(
        [("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("queries", pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("floor", pa.int64())])))]
    )
    groups = cut(dealt.mapInArrow(index, "ids binary, vectors binary, width bigint, high binary, low binary, queries array<struct<id: bigint, v: array<bigint>, floor: bigint>>"))
    groups = groups.withColumn("_group", F.monotonically_increasing_id())

    asked = groups.select(F.explode("queries").alias("q")).select("q.*").groupBy("id").agg(F.min(F.struct("v", "floor")).alias("q"))
    asked = asked.select(F.col("id"), "q.v", "q.floor")

    def block_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, query_block):
                part = batch.slice(at, query_block)
                vectors = dense(part["v"])
                yield pa.RecordBatch.from_pydict(
                    {"q_ids": [part["id"].to_numpy().tobytes()], "q_vectors": [vectors.tobytes()], "q_width": [vectors.shape[1]], "q_floors": [part["floor"].to_numpy().tobytes()]},
                    schema=pa.schema([("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("q_width", pa.int64()), ("q_floors", pa.binary())]),
                )

    blocks = asked.mapInArrow(block_queries, "q_ids binary, q_vectors binary, q_width bigint, q_floors binary")
    # every block of queries meets every range's bounds once: ranges are dealt out, blocks go to all deals
    deals = min(n_groups, DEALS)
    bounds = groups.select("_group", "width", "high", "low", F.pmod(F.xxhash64("_group"), F.lit(deals)).alias("_deal"))
    offered = cut(blocks).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).join(bounds, "_deal").drop("_deal")

    def within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_group", "q_ids", "q_vectors", "q_width", "q_floors"]
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                matrix = lambda name, width: np.frombuffer(at[name], np.int64).reshape(-1, at[width])
                queries, floors = matrix("q_vectors", "q_width"), np.frombuffer(at["q_floors"], np.int64)
                if at["width"] and at["q_width"]:
                    ceiling = block_bounds(queries, matrix("high", "width"), matrix("low", "width")).max(axis=1)
                else:
                    ceiling = np.zeros(len(floors), np.int64)
                live = np.flatnonzero(ceiling >= floors)
                if len(live):
                    ids = np.frombuffer(at["q_ids"], np.int64)[live]
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip([at["_group"], ids.tobytes(), queries[live].tobytes(), at["q_width"], floors[live].tobytes()], [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()], strict=True)], names)

    reached = offered.mapInArrow(within_reach, "_group bigint, q_ids binary, q_vectors binary, q_width bigint, q_floors binary")
    pairs = reached.join(groups.select("_group", "ids", "vectors", "width"), "_group")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids, q_ids = np.frombuffer(at["ids"], np.int64), np.frombuffer(at["q_ids"], np.int64)
                group = Group(ids, np.frombuffer(at["vectors"], np.int64).reshape(len(ids), at["width"]), block)
                queries = np.frombuffer(at["q_vectors"], np.int64).reshape(len(q_ids), at["q_width"])
                found = group.search(q_ids, queries, k, np.frombuffer(at["q_floors"], np.int64))
                hits = [(int(q), i, -s) for q, best in zip(q_ids, found, strict=True) for s, i in best]
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in (zip(*hits, strict=True) if hits else ([], [], []))], ["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, over all embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op4_topk_search": op4_topk_search}
ORACLES = {
    "op4_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
}
