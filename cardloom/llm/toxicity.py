"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from itertools import repeat
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.language_id import id_remainder
from cardloom.llm.near_dedup import linked, shingle_sets, signed
from cardloom.llm.shingles import Bands
from cardloom.llm.text import text_or_empty
from cardloom.session import table, written

TERM = re.compile(r"[^\W\d_]+")
#: Cosines this close are one value: sums of the same products in another order.
DIGITS = 12


def terms_of(text: str | None) -> list[str]:
    """The runs of letters of a whole text, in lower case."""
    return TERM.findall((text or "").lower())


def labelled_sample(docs: DataFrame, known: DataFrame, max_examples: int, key: str, text: str) -> DataFrame:
    """doc, toxic, text: of the rows of either label at most half of max_examples, those first by hash of the id; of several texts of an id the largest."""
    first = lambda label: known.filter(F.col("toxic") == label).orderBy(F.xxhash64(key), key).limit(max_examples // 2)
    picked = first(0).unionByName(first(1))
    texts = docs.select(F.col(key), text_or_empty(text).alias("text")).join(F.broadcast(picked), key)
    return texts.groupBy(F.col(key).alias("doc")).agg(F.max(F.struct("text", "toxic")).alias("_row")).select("doc", "_row.toxic", "_row.text")


def independent(sample: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The sample without near copies (0.8 of their 5-word shingles) of an earlier row of the same label.

    A changed copy is no further evidence for its words; one with the other label is. Rows that
    share a minhash bucket are held against the first of it, by their whole sets.
    """
    rows = sample.withColumn("_node", F.xxhash64("doc"))
    keys = signed(rows, "_node", "text", width, Bands.for_threshold(float(threshold)))
    placed = rows.select("_node", "toxic").join(keys.select(F.col("doc").alias("_node"), F.explode("keys").alias("key")), "_node")
    first = placed.groupBy("key", "toxic").agg(F.min("_node").alias("center"))
    pairs = placed.join(first, ["key", "toxic"]).filter("_node <> center").select("_node", "center").distinct()
    sets = shingle_sets(rows, rows.select(F.col("_node").alias("doc")), "_node", "text", width)
    both = pairs.join(sets.withColumnRenamed("doc", "_node"), "_node").join(sets.select(F.col("doc").alias("center"), F.col("set").alias("set_c")), "center")
    copies = both.filter(linked("set", "set_c", threshold)).select("_node").distinct()
    return rows.join(copies, "_node", "left_anti").drop("_node")


def term_counts(texts: DataFrame, keep: frozenset[str] | None = None) -> DataFrame:
    """term, n, toxic_n: texts that hold each term, summed in each task before they are shuffled.

    With keep, only its terms are counted.
    """
    shared = texts.sparkSession.sparkContext.broadcast(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        held: Counter = Counter()
        toxic_held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            names = list(held)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[t] for t in names], pa.int64()), pa.array([toxic_held[t] for t in names], pa.int64())], ["term", "n", "toxic_n"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                distinct = set(terms_of(text.as_py()))
                distinct = distinct if keep is None else distinct & keep
                held.update(distinct)
                if toxic:
                    toxic_held.update(distinct)
            if len(held) > 1 << 18:
                yield counted()
                held.clear()
                toxic_held.clear()
        yield counted()

    counted = texts.select("text", "toxic").mapInArrow(count, "term string, n bigint, toxic_n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic_n").alias("toxic_n"))


def surprise(n: np.ndarray, toxic_n: np.ndarray, examples: int, toxic: int) -> np.ndarray:
    """Likelihood ratio statistic (G) of each term's 2 x 2 table of presence and label."""
    cells = np.array([[toxic_n, n - toxic_n], [toxic - toxic_n, examples - toxic - (n - toxic_n)]], float)
    expected = cells.sum(axis=0, keepdims=True) * cells.sum(axis=1, keepdims=True) / max(examples, 1)
    logs = np.log(np.divide(cells, expected, out=np.ones_like(cells), where=cells > 0))
    return 2 * (cells * logs).sum(axis=(0, 1))


def term_gains(n: np.ndarray, toxic_n: np.ndarray, examples: int, toxic: int) -> np.ndarray:
    """How much more than its inverse document frequency a term counts: G over what chance gives about one of all terms, 1 at least.

    Terms that only chance ties to a label keep plain TF-IDF weights; none has less.
    """
    tried = int((n >= 3).sum())
    chance = NormalDist().inv_cdf(1 - 0.5 / max(tried, 2)) ** 2
    return np.maximum(1.0, surprise(n, toxic_n, examples, toxic) / chance)


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions lo[i] .. hi[i] - 1 of all ranges, and the i of each."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + (lo - (np.cumsum(n) - n))[owner], owner


@dataclass
class Vocabulary:
    """The examples' terms and their weights: inverse document frequency over all documents, times the gain."""

    terms: list[str]
    weights: np.ndarray

    @cached_property
    def at(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in order and (1 + log count) times weight, of unit length; empty without a known term."""
        terms = terms_of(text)
        found = np.fromiter(map(self.at.get, terms, repeat(-1)), np.int64, len(terms))
        ids, times = np.unique(found[found >= 0], return_counts=True)
        values = (1 + np.log(times)) * self.weights[ids]
        norm = np.sqrt(values @ values)
        return (ids, values / norm) if norm else (np.empty(0, np.int64), np.empty(0))


class BlockMaxIndex:
    """Postings of each term by blocks of consecutive examples, with the largest weight of every term in every block."""

    def __init__(self, n_terms: int, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = 64):
        self.n, self.block = len(vectors), block
        term = np.concatenate([np.empty(0, np.int64), *(ids for ids, _ in vectors)])
        place = np.repeat(np.arange(self.n), [len(ids) for ids, _ in vectors])
        weight = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        order = np.lexsort((place, term))
        term, self.place, self.weight = term[order], place[order], weight[order]
        #: A run is what one term has in one block.
        starts = np.flatnonzero(np.diff(term * (self.n + 1) + self.place // block, prepend=-1))
        self.run_lo, self.run_hi = starts, np.append(starts[1:], len(term))[: len(starts)]
        self.run_block = self.place[starts] // block
        self.run_max = np.maximum.reduceat(self.weight, starts) if len(starts) else np.empty(0)
        self.term_runs = np.searchsorted(term[starts], np.arange(n_terms + 1))
        self.visited = self.offered = 0

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, the larger cosine and then the earlier place first.

        A block's bound is the sum over terms of the query's weight times the block's maximum.
        The four blocks of the largest bounds are scored first; they give a floor of the kth cosine,
        and of the others those whose bound reaches it are scored.
        """
        runs, owner = expand(self.term_runs[ids], self.term_runs[ids + 1])
        blocks = self.run_block[runs]
        n_blocks = -(-self.n // self.block)
        bounds = np.bincount(blocks, weights[owner] * self.run_max[runs], n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        self.offered += n_blocks
        places, cosines, kth, at, width = np.empty(0, np.int64), np.empty(0), 0.0, 0, 4
        while at < len(order):
            due = order[at : at + width]
            due = due[bounds[due] >= kth - 1e-9]
            if not len(due):
                break
            self.visited += len(due)
            wanted = np.zeros(n_blocks, bool)
            wanted[due] = True
            mine = np.flatnonzero(wanted[blocks])
            postings, run = expand(self.run_lo[runs[mine]], self.run_hi[runs[mine]])
            scores = np.bincount(self.place[postings], weights[owner[mine]][run] * self.weight[postings], self.n)
            if skip >= 0:
                scores[skip] = 0
            scores = scores.round(DIGITS)
            new = np.flatnonzero((scores > 0) & (scores >= kth))
            places, cosines = np.concatenate([places, new]), np.concatenate([cosines, scores[new]])
            if len(places) > k:
                above = cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                places, cosines = places[above], cosines[above]
            best = np.lexsort((places, -cosines))[:k]
            places, cosines = places[best], cosines[best]
            kth = cosines[-1] if len(cosines) == k else 0.0
            at, width = at + width, len(order)
        return places, cosines


@dataclass
class ToxicityModel:
    """The vocabulary, the index of the examples, and the calibration of the votes."""

    vocabulary: Vocabulary
    index: BlockMaxIndex
    docs: np.ndarray
    toxic: np.ndarray
    k: int
    edges: np.ndarray
    rates: np.ndarray

    def vote(self, text: str | None, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Toxic share among the nearest examples, by cosine over distance, with half a vote of the sample's own share; their places and cosines."""
        places, cosines = self.index.nearest(*self.vocabulary.vector(text), self.k, skip)
        weights = cosines / (1.05 - cosines)
        return float((weights @ self.toxic[places] + self.toxic.mean() / 2) / (weights.sum() + 0.5)) if len(self.toxic) else 0.0, places, cosines

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.edges, self.rates))


def monotone(votes: np.ndarray, outcomes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean vote and smoothed rate of each pool."""
    pools: list[list[float]] = []
    order = np.argsort(votes, kind="stable")
    values, starts = np.unique(votes[order], return_index=True)
    for vote, at in zip(values, np.split(order, starts[1:]), strict=True):
        n = float(weights[at].sum())
        pools.append([float(vote) * n, float(weights[at] @ outcomes[at]), n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    v, h, n = np.array(pools).T
    return v / n, (h + 0.5) / (n + 1)


def learn_vocabulary(docs: DataFrame, examples: DataFrame, text: str) -> Vocabulary:
    """Every term of the examples; document frequencies count all documents, gains the examples."""
    n, toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    held = term_counts(examples).orderBy("term").toPandas()
    terms = held["term"].tolist()
    if not terms:
        return Vocabulary([], np.empty(0))
    total = docs.count()
    everywhere = term_counts(docs.select(text_or_empty(text).alias("text"), F.lit(0).alias("toxic")), frozenset(terms)).toPandas()
    df = everywhere.set_index("term")["n"].reindex(terms).fillna(0).to_numpy(float)
    gains = term_gains(held["n"].to_numpy(), held["toxic_n"].to_numpy(), n, toxic)
    return Vocabulary(terms, np.log((1 + total) / (0.5 + df)) * gains)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 3000, k: int = 25, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model from at most max_examples labelled rows, half of them of either label, one of each group of near copies and label.

    All terms of these examples are in the vectors. A term's weight is its inverse document
    frequency over all documents, times a gain for terms whose tie to the label is beyond chance.
    What reaches the driver is bounded by the examples: their terms and vectors, and one vote for
    each, taken in tasks without the example itself. The calibration is learned from these, either
    label weighted by its share of all labelled rows.

    Null ids, labels other than 0 and 1, and labels of unknown documents are left out; of several
    labels of an id the largest counts; null texts
    count as empty, and examples without letters or repeated ones are examples like others. Without
    examples, or without toxic ones, every score is 0.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("toxic"))
    share = float(known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])
    sample = written(labelled_sample(docs, known, max_examples, key, text))
    examples = written(independent(sample))
    vocabulary = learn_vocabulary(docs, examples, text)
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [words.value.vector(x.as_py()) for x in batch.column("text")]
            counts = [max(Counter(terms_of(x.as_py())).items(), key=lambda c: (c[1], c[0]), default=("", 0))[0] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").cast(pa.string()), batch.column("toxic").cast(pa.int32()), pa.array(counts, pa.string()), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([w.tobytes() for _, w in rows], pa.binary())],
                ["doc", "toxic", "leading", "ids", "weights"],
            )

    rows = examples.mapInArrow(project, "doc string, toxic int, leading string, ids binary, weights binary").toPandas()
    vectors = [(np.frombuffer(i, np.int64), np.frombuffer(w)) for i, w in zip(rows["ids"], rows["weights"], strict=True)]
    # neighbours in the index share their commonest word, most often that of a language, and then their heaviest
    heaviest = [int(i[np.argmax(w)]) if len(i) else -1 for i, w in vectors]
    order = sorted(range(len(rows)), key=lambda r: (rows["leading"][r], heaviest[r], rows["doc"][r]))
    index = BlockMaxIndex(len(vocabulary.terms), [vectors[r] for r in order])
    toxic = rows["toxic"].to_numpy(float)[order]
    model = ToxicityModel(vocabulary, index, rows["doc"].to_numpy()[order], toxic, k, np.array([0.0, 1.0]), np.zeros(2))
    if not toxic.any():
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = {doc: i for i, doc in enumerate(model.docs)}
        for batch in batches:
            names = batch.column("doc").cast(pa.string()).to_pylist()
            votes = [model.vote(x.as_py(), at[name])[0] for name, x in zip(names, batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("toxic").cast(pa.float64())], ["vote", "toxic"])

    spread = examples.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), F.xxhash64("doc"))
    votes = spread.mapInArrow(vote, "vote double, toxic double").toPandas()
    outcomes = votes["toxic"].to_numpy()
    weights = np.where(outcomes > 0, share / outcomes.mean(), (1 - share) / max(1 - outcomes.mean(), 1e-9))
    model.edges, model.rates = monotone(votes["vote"].to_numpy().round(6), outcomes, weights)
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with score, predicted and evidence: calibrated toxicity, score >= threshold as 1 or 0, and the ids of the nearest examples.

    Every text is read as a whole; one without a term of the examples, an empty or a null text has
    the calibrated base rate and no evidence. Equal texts score alike, other columns stay but
    for those named like the added ones, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known: dict[int, tuple] = {}
        for batch in batches:
            out = []
            for text in batch:
                name = xxhash.xxh3_128_intdigest((text or "").encode("utf-8", "surrogatepass"))
                if name not in known:
                    if len(known) > 1 << 16:
                        known.clear()
                    vote, places, _ = model.vote(text)
                    known[name] = (model.calibrated(vote), model.docs[places[:5]].tolist())
                out.append(known[name])
            yield pd.DataFrame(out, columns=["score", "evidence"])

    scored = docs.drop("score", "predicted", "evidence").withColumn("_s", judge(F.col(text).cast("string")))
    return scored.select("*", "_s.*").drop("_s").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
