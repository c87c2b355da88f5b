"""Periodic runs of words: difference-cover longest common extensions on a harmonic grid."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.text import WORD, text_or_empty
from cardloom.session import table

#: A perfect difference cover, in which every distance modulo CYCLE is that of two of its members.
CYCLE = 7
COVER = (1, 2, 4)
#: Words that are searched together, or one document if that has more.
BATCH_WORDS = 1 << 19
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by keys, the first key foremost, and each row's dense rank; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        held = key[order]
        new[1:] |= held[1:] != held[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class Extensions:
    """Longest common extensions to the right in a sequence of words that ends in a word found nowhere else.

    Only suffixes that begin at a place of the difference cover are sorted: their first CYCLE words
    give a rank, and as places a multiple of CYCLE apart are in the cover alike, ranks of twice the width follow
    from two of the width before. Neighbours in the order have common prefixes that the same ranks
    give, and a sparse table gives the least of any stretch of them. Any two places meet the cover
    together within fewer than CYCLE steps; these few words are compared one by one.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        # CYCLE more words of their own at the end, so that no comparison needs a bound
        self.words = np.concatenate([words.astype(np.int64), words.max(initial=0) + 1 + np.arange(2 * CYCLE)])
        within = np.zeros(CYCLE, bool)
        within[list(COVER)] = True
        self.places = np.flatnonzero(within[np.arange(n) % CYCLE])
        self.number = np.full(n + 2 * CYCLE, -1, np.int64)
        self.number[self.places] = np.arange(len(self.places))
        residues = np.arange(CYCLE)
        steps = np.arange(CYCLE)
        meet = within[(residues[:, None, None] + steps) % CYCLE] & within[(residues[None, :, None] + steps) % CYCLE]
        #: Steps to the cover from two residues.
        self.steps = meet.argmax(axis=2)
        self.sort()

    def sort(self) -> None:
        windows = [self.words[self.places + at] for at in range(CYCLE)]
        bits = int(self.words.max()).bit_length()
        each = max(1, 62 // bits)  # words that one key holds
        keys = []
        for at in range(0, CYCLE, each):
            key = windows[at]
            for window in windows[at + 1 : at + each]:
                key = (key << bits) | window
            keys.append(key)
        order, rank = ranks(keys)
        levels, width, m = [rank], CYCLE, len(self.places)
        while m and rank.max() + 1 < m:
            beyond = np.full(m, 0, np.int64)
            follows = self.places + width
            inside = follows < len(self.number) - 2 * CYCLE
            beyond[inside] = rank[self.number[follows[inside]]] + 1
            order, rank = ranks([rank * (m + 1) + beyond])
            levels.append(rank)
            width *= 2
        self.rank = rank
        a, b = self.places[order[:-1]], self.places[order[1:]]
        common = np.zeros(len(a), np.int64)
        end = len(self.number) - 2 * CYCLE
        for level in reversed(levels):
            ia, ib = a + common, b + common
            at = np.flatnonzero((ia < end) & (ib < end))
            same = at[level[self.number[ia[at]]] == level[self.number[ib[at]]]]
            common[same] += width
            width //= 2
        alive = np.arange(len(a))
        for _ in range(CYCLE):
            alive = alive[self.words[np.minimum(a[alive] + common[alive], end)] == self.words[np.minimum(b[alive] + common[alive], end + 1)]]
            common[alive] += 1
        table_ = [common]
        step = 1
        while 2 * step <= len(common):
            last = table_[-1].copy()
            last[: len(last) - step] = np.minimum(last[: len(last) - step], last[step:])
            table_.append(last)
            step *= 2
        self.table = np.stack(table_)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a on equal those from places b on; a and b differ."""
        found = self.steps[a % CYCLE, b % CYCLE]
        matched = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        for step in range(CYCLE - 1):
            alive = alive[found[alive] > step]
            alive = alive[self.words[a[alive] + step] == self.words[b[alive] + step]]
            matched[alive] += 1
        met = np.flatnonzero(matched == found)
        x, y = self.rank[self.number[a[met] + found[met]]], self.rank[self.number[b[met] + found[met]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        matched[met] += np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        return matched


def near(words: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words equal each other from a and b on in one direction, up to CYCLE of them."""
    matched = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for at in range(CYCLE):
        alive = alive[words[a[alive] + at * step] == words[b[alive] + at * step]]
        matched[alive] += 1
    return matched


def grid(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods p with words[i] == words[i + p], i running over the multiples of p.

    Documents come by falling size, so those that hold a run of a period are the first ones. There are
    n / p places for a period, n times the harmonic number of the longest document in all. A run
    holds p consecutive places that equal those p further on, so one of them is on the grid.
    """
    at, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(1, int(sizes[0]) // 2 + 1 if len(sizes) else 1):
        fit = int(np.searchsorted(-sizes, -max(2 * p, least), "right"))
        if not fit:
            break
        part = words[: ends[fit - 1]]
        hits = np.flatnonzero(part[:-p:p] == part[p::p]) * p
        at.append(hits)
        periods.append(np.full(len(hits), p))
    return np.concatenate(at), np.concatenate(periods)


def find_runs(documents: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """The runs of each document as rows start, length, period, by start and period.

    A run is a longest stretch with smallest period q and a length of at least max(least, 2 * q).
    """
    by_size = sorted(range(len(documents)), key=lambda at: -len(documents[at]))
    sizes = np.array([len(documents[at]) for at in by_size], np.int64)
    found = [np.zeros((0, 3), np.int64)] * len(documents)
    top = max((int(d.max(initial=0)) for d in documents), default=0) + 1
    # each document ends in a word of its own; CYCLE more at either end, so that no comparison needs a bound
    parts = [np.append(documents[at], top + CYCLE + turn) for turn, at in enumerate(by_size)]
    body = np.concatenate([top + np.arange(CYCLE), *parts, top + CYCLE + len(parts) + np.arange(CYCLE)]).astype(np.int64)
    ends = CYCLE + np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    at, period = grid(body[CYCLE:], ends - CYCLE, sizes, least)
    at += CYCLE
    needed = np.maximum(period, least - period)
    right, left = near(body, at, at + period, 1), near(body, at - 1, at + period - 1, -1)
    open_ = (right == CYCLE) | (left == CYCLE)
    likely = np.flatnonzero(open_ | (right + left >= needed))
    at, period, needed, right, left, open_ = (x[likely] for x in (at, period, needed, right, left, open_))
    if open_.any():  # sort the suffixes of the documents in which a few words don't decide
        owner = np.searchsorted(begins, at, "right") - 1
        deep = np.unique(owner[open_])
        pieces = np.concatenate([[body[0]], *(body[begins[d] : ends[d] + 1] for d in deep)])
        shift = np.zeros(len(sizes), np.int64)
        shift[deep] = 1 + np.concatenate([[0], np.cumsum(sizes[deep] + 1)[:-1]]) - begins[deep]
        a = at[open_] + shift[owner[open_]]
        b = a + period[open_]
        right[open_] = Extensions(pieces).common(a, b)
        left[open_] = Extensions(pieces[::-1]).common(len(pieces) - a, len(pieces) - b)
    whole = np.flatnonzero(right + left >= needed)
    start, end, period = (at - left)[whole], (at + period + right)[whole], period[whole]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # a stretch has its smallest period first; multiples of it have the same ends
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    owner = np.searchsorted(begins, start, "right") - 1
    cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
    rows = np.stack([start - begins[owner], end - start, period], axis=1) if len(start) else np.zeros((0, 3), np.int64)
    for turn, document in enumerate(by_size):
        found[document] = rows[cuts[turn] : cuts[turn + 1]]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run repeats: those that lie in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs, collapsed: the periodic runs of the words of whole texts, and the text without the repeats.

    runs are structs of start (word number from 0), length and smallest period, by start, then period; each is as long as
    its period allows and at least max(least, two periods) long. collapsed joins by one space the words that
    lie in no run after its first period. A null or empty text has no words, no runs and an empty
    collapsed text. Very long texts are searched whole. Stretches of equal ends count once, with their
    smallest period. Repeated rows and null ids are searched like others; an empty table gives an
    empty one. Other columns are not read, so clashing names do no harm. Documents don't
    depend on each other: nothing is shuffled, and a task holds a batch of words at a time.
    """
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    names = ["_key", "n_words", "runs", "collapsed"]

    def result(keys: pa.Array, texts: list[bytes], coded: list[np.ndarray]) -> pa.RecordBatch:
        found = find_runs(coded, least)
        collapsed = []
        for body, runs, codes in zip(texts, found, coded, strict=True):
            words = body.split()
            collapsed.append(b" ".join(words if not len(runs) else [words[at] for at in np.flatnonzero(kept_words(len(codes), runs))]))
        rows = np.concatenate(found)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(rows[:, at]) for at in range(3)], fields=list(run_type))
        columns = [keys, pa.array([len(x) for x in coded], pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: defaultdict = defaultdict(count().__next__)
            texts: list[bytes] = []
            coded: list[np.ndarray] = []
            start = held = 0
            for at in range(batch.num_rows):
                body = batch.column(1)[at].as_buffer()
                texts.append(body.to_pybytes() if body else b"")
                coded.append(np.array(list(map(number.__getitem__, texts[-1].split())), np.int64))
                held += len(coded[-1]) + 1
                if held >= BATCH_WORDS:
                    yield result(batch.column(0).slice(start, at + 1 - start), texts, coded)
                    number, texts, coded, start, held = defaultdict(count().__next__), [], [], at + 1, 0
            if texts:
                yield result(batch.column(0).slice(start), texts, coded)

    narrow = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    return narrow.mapInArrow(search, f"_key {kind}, n_words bigint, runs {RUN_TYPE}, collapsed string").withColumnRenamed("_key", key)


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text of one document in ten with its words from some place on repeated in a period, as its id's hash decides."""
    hashed = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    g, n = F.floor(hashed / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, 1, a), F.slice(repeated, 1, n - a)), " ")
    return F.when((hashed % 10 == 0) & text.rlike(WORD), planted).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, one in ten of them with a planted period."""
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", with_planted_period(F.col("doc_id"), text_or_empty("text")).alias("text"))
    found = periodic_runs(planted)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.shorter")).alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("-1000 * _best.shorter div _best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
