"""An inverted-file index of unit vectors: trained cells, posting lists, probes and exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators.vectors import best_of_blocks, named_as_queries, packed
from cardloom.session import written


#: Rows that a task makes at a time when rows go to several cells each.
MOST = 16_384


@dataclass(frozen=True)
class VectorIndex:
    """Cells (rows of unit length), how many of them a search probes, and the written posting lists: cell, ids, vectors."""

    cells: np.ndarray
    probes: int
    postings: DataFrame


def trained_cells(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means: each round moves a cell to the mean direction of its vectors; empty cells take the vector worst served."""
    draw = np.random.default_rng(seed)
    centers = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ centers.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1))[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return centers


def probes_for(sample: np.ndarray, cells: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """The least probes with which the share of the k nearest of sampled queries that lie in a probed cell is at least recall."""
    queries = sample[:asked]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    own = (sample @ cells.T).argmax(axis=1)
    turn = np.argsort(np.argsort(-(queries @ cells.T), axis=1), axis=1)  # the turn at which a query probes each cell
    turns = np.sort(np.take_along_axis(turn, own[best], 1).ravel())
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))]) + 1 if len(turns) else 1


def to_cells(rows: DataFrame, cells: np.ndarray, probes: int) -> DataFrame:
    """id, v and cell for each of the nearest probes cells of a row; a batch is taken in steps of at most MOST rows to write, as its rows times probes grow with the index."""
    step = max(1, min(MOST // 16, MOST // max(1, probes)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if len(cells) else 0, step):
                few = batch.slice(at, step)
                near = few.column("v").flatten().to_numpy().reshape(few.num_rows, -1) @ cells.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                rows_ = few.take(pa.array(np.repeat(np.arange(few.num_rows), best.shape[1])))
                yield pa.RecordBatch.from_arrays([rows_.column("id"), rows_.column("v"), pa.array(best.ravel())], ["id", "v", "cell"])

    ready = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return ready.mapInArrow(assign, "id bigint, v array<double>, cell bigint")


def build_index(rows: DataFrame, k: int = 10, recall: float = 0.97, max_train: int = 20_000, cells: int | None = None) -> VectorIndex:
    """An index of every row (id, v of unit length and one dimension), written under the checkpoint folder.

    Cells are trained on a sample: the max_train rows with the least hash of their id, 16 MB for 100 dimensions, which the driver holds. There are as
    many cells as the square root of the number of rows, at most an eighth of the sample. The same sample tells how many cells a
    search has to probe for the recall wanted. A cell of any size is a number of blocks, dealt by range with ids, so a hot cell lies in many
    tasks and files. No rows give an index without cells, which finds nothing.
    """
    n = rows.count()
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max_train).select("v").toArrow().column("v").combine_chunks()
    trained = sample.flatten().to_numpy().astype(float).reshape(len(sample), -1) if len(sample) else np.zeros((0, 1))
    centers = trained_cells(trained, cells or max(1, min(int(n**0.5), len(trained) // 8))) if len(trained) else trained
    probes = probes_for(trained, centers, k, recall) if len(trained) else 1
    placed = to_cells(rows, centers, 1).repartitionByRange("cell", "id")
    return VectorIndex(centers, probes, written(packed(placed, 4096, ["cell"])))


def indexed_search(queries: DataFrame, index: VectorIndex, k: int = 10, probes: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank, id, similarity like cosine_search, over the rows of the nearest cells of each query; all cells give the exact result.

    Queries meet the blocks of the cells that they probe, and only these; found rows are ranked by their exact cosine.
    """
    asked = to_cells(queries, index.cells, min(probes or index.probes, max(1, len(index.cells))))
    blocks = named_as_queries(packed(asked.repartition("cell"), 512, ["cell"]))
    return best_of_blocks(blocks.join(index.postings, "cell"), k, digits)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, hits: how many of the exact results of each query were found; a tie with the last of them counts as it."""
    last = exact.groupBy("query_id").agg(F.min("similarity").alias("_least"), F.count(F.lit(1)).alias("wanted"))
    good = found.join(last.select("query_id", "_least"), "query_id").filter(F.col("similarity") >= F.col("_least")).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return last.join(good, "query_id", "left").select("query_id", "wanted", F.least("wanted", F.coalesce("_n", F.lit(0))).alias("hits"))
