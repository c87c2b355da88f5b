"""Packing token sequences into windows by non-negative least squares over length combinations."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.numbering import number_within
from cardloom.llm.text import text_or_empty
from cardloom.session import cut, table, written

#: Pre-tokens whose ids a task remembers before it starts anew.
REMEMBERED = 1 << 19
#: Fixed value: the pre-token pattern of the vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + at) for at, b in enumerate(others)}


#: Code points below this are split by the quicker of two equal patterns.
COMMON = 0x250


@cache
def common_pattern() -> re.Pattern[str]:
    """PRE_TOKEN over texts of code points below COMMON alone, with the letters, numbers and white space among these spelled out."""
    import regex

    chars = [chr(c) for c in range(COMMON)]
    letters, numbers, space = ("".join(map(re.escape, filter(regex.compile(kind).match, chars))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


class Remembered(dict):
    """The ids of pre-tokens as bytes; those not known yet are encoded by the model."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.letters = tokenize, byte_letters()

    def __missing__(self, part: str) -> bytes:
        spelled = part.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        self[part] = ids = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        return ids


class Encoder:
    """Token ids of texts by a byte-level BPE file of the tokenizers library.

    Texts are split at the vocabulary's own pre-token pattern; the library's model encodes each
    distinct pre-token once, and its ids are remembered as bytes. Merges never cross pre-tokens, so
    the ids are those of the whole text.

    Texts are first split at the file's added tokens, which have ids of their own.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN).findall
        self.split_common = common_pattern().findall
        self.is_uncommon = re.compile(f"[{chr(COMMON)}-{chr(0x10FFFF)}]").search
        tokens = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens.values()):
            raise ValueError("added tokens that depend on what is around them are not supported")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in tokens.items()}
        longest_first = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.apart = regex.compile(f"({longest_first})").split if self.added else lambda text: [text]
        self.known = Remembered(tokenizer.model.tokenize)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids (the machine's order, as all that Spark runs on)."""
        return b"".join(self.added[part] if at % 2 else self.between(part) for at, part in enumerate(self.apart(text)))

    def between(self, text: str) -> bytes:
        """The ids of a text in which added tokens have no meaning."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = self.split(text) if self.is_uncommon(text) else self.split_common(text)
        return b"".join(map(self.known.__getitem__, parts))


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process, so that its tasks share what it remembers."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, vocabulary: str, window: int, end_id: int, key: str, text: str) -> DataFrame:
    """One row for each document: full-window checksums, and its remainder with ids.

    doc, tokens, full_crcs, length, ids, crc: length, ids (little-endian unsigned 32-bit, deflated)
    and crc are those of the part after the last full window, length 0 if there is none.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for x in part.column(1):
                    ids = encoder.encode(x.as_py()) + end
                    full = len(ids) // (4 * window)
                    rest = ids[full * 4 * window :]
                    rows.append((len(ids) // 4, [zlib.crc32(ids[i * 4 * window : (i + 1) * 4 * window]) for i in range(full)], len(rest) // 4, zlib.compress(rest, 1) if rest else b"", zlib.crc32(rest)))
                tokens, crcs, length, ids, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())],
                    ["doc", "tokens", "full_crcs", "length", "ids", "crc"],
                )

    return docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text")).mapInArrow(
        encode, "doc bigint, tokens bigint, full_crcs array<bigint>, length bigint, ids binary, crc bigint"
    )


def patterns(window: int, fine: int = 8) -> np.ndarray:
    """Shallow combinations of lengths that fill a window: rows of four lengths, largest first, zeros at the end.

    Enumerated: every pair; every triple whose second piece is a whole share of what the first
    leaves, in steps of 1 / (2 * fine); and every four pieces whose second and third are whole shares in
    steps of 1 / fine. So every length is combined with lengths of all sizes, not with a few round ones.
    """
    lengths = np.arange(1, window)
    pairs = np.column_stack([lengths, window - lengths])
    share = lambda left, i, steps: np.maximum(1, left * i // steps)
    found = [np.pad(pairs, ((0, 0), (0, 2)))]
    for i in range(1, fine + 1):
        left = window - lengths
        second = share(left, i, 2 * fine)
        found.append(np.column_stack([lengths, second, left - second, np.zeros_like(left)]))
        for j in range(1, fine):
            second = share(left, i, 2 * fine)
            third = share(left - second, j, fine)
            found.append(np.column_stack([lengths, second, third, left - second - third]))
    rows = np.concatenate(found)
    rows = rows[(rows >= 0).all(axis=1)]
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def solve_repeats(combos: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares: repeats x of each combination with sum of its lengths near the histogram.

    Accelerated projected gradient (Beck and Teboulle, 2009) on || A x - h ||, with columns scaled to
    one norm. A is never built: its columns hold at most a few entries.
    """
    scale = 1 / np.sqrt(np.array([(np.unique(row[row > 0], return_counts=True)[1] ** 2).sum() for row in combos], float))
    flat, n = combos.ravel(), len(histogram)
    forward = lambda x: np.bincount(flat, np.repeat(x * scale, combos.shape[1]), n) * (np.arange(n) > 0)
    backward = lambda r: r[combos].sum(axis=1) * scale
    target = histogram.astype(float).copy()
    target[0] = 0
    vector = np.ones(len(combos))
    for _ in range(20):
        vector = backward(forward(vector))
        vector /= np.linalg.norm(vector)
    lipschitz = float(np.linalg.norm(backward(forward(vector)))) * 1.01
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - backward(forward(y) - target) / lipschitz)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / t_next * (z - x)
        x, t = z, t_next
    return x * scale


def round_repeats(combos: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeats that use no length more often than it occurs: rounded down, then raised from the largest on.

    Raising goes over the combinations once, each by what its lengths still allow.
    """
    left, rows = histogram.tolist(), [tuple(x for x in row if x) for row in combos.tolist()]
    whole, order = np.zeros(len(rows), np.int64), np.argsort(-repeats, kind="stable").tolist()
    for wanted in (np.floor(repeats).astype(np.int64).tolist(), None):
        for p in order:
            more = min(left[x] // rows[p].count(x) for x in rows[p])
            more = more if wanted is None else min(more, wanted[p])
            if more:
                whole[p] += more
                for x in rows[p]:
                    left[x] -= more
    return whole


def plan_places(histogram: np.ndarray, window: int) -> pd.DataFrame:
    """length, first, last, sequence, offset: pieces number first .. last - 1 of a length go to
    consecutive sequences from sequence on, at offset. Numbers beyond the last row are left over."""
    combos = patterns(window)
    combos = combos[(histogram[combos] > 0).sum(axis=1) == (combos > 0).sum(axis=1)]
    if not len(combos):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("length", "first", "last", "sequence", "offset")})
    whole = round_repeats(combos, solve_repeats(combos, histogram), histogram)
    used, rows, sequence = np.zeros(window + 1, np.int64), [], 0
    for p in np.flatnonzero(whole):
        offset = 0
        for length in combos[p][combos[p] > 0]:
            rows.append((length, used[length], used[length] + whole[p], sequence, offset))
            used[length] += whole[p]
            offset += length
        sequence += whole[p]
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"]).astype(np.int64)


def pack(docs: DataFrame, window: int = 2048, vocabulary: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of tokenized documents in sequences of at most window tokens.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id, offset: a piece holds its
    document's ids start .. start + length - 1 and lies at offset in its sequence; ids_crc32 is over
    little-endian unsigned 32-bit ids. The vocabulary's added tokens have their own ids wherever a
    text holds them. Documents end with end_id; a null text counts as empty and gives that id alone. Rows with a null id are packed like others. Repeated rows are packed each.
    An empty table gives no pieces. Other columns are not read.

    Full windows of a document are sequences of their own. What is left over of each document has
    one of window - 1 lengths; their histogram, as bounded as the window, goes to the driver, where
    non-negative least squares choose repeats for shallow combinations that fill a window.
    Rounded repeats place whole pieces: the n-th piece of a length has a known sequence and offset,
    and pieces are numbered without bringing a length together. Pieces left over by rounding are
    packed greedily in each task, cut at window ends; a task's last sequence is cut into powers of
    two, which need no padding.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    every = written(tokenized(docs, vocabulary or default_vocabulary(), window, end_id, key, text))

    named = ["doc", "start", "length", "crc", "tokens", "family", "sequence", "offset"]
    full = cut(every.filter(F.size("full_crcs") > 0).select("doc", "tokens", F.posexplode("full_crcs").alias("at", "crc")))
    full = full.select("doc", (F.col("at").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "crc", "tokens", F.lit(0).alias("family"), F.monotonically_increasing_id().alias("sequence"), F.lit(0).cast("long").alias("offset"))

    rest = every.filter("length > 0").select("doc", (F.col("tokens") - F.col("length")).alias("start"), "length", "crc", "tokens", "ids")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in every.filter("length > 0").groupBy("length").count().collect():  # at most window - 1 rows
        histogram[length] = n
    places = plan_places(histogram, window)
    numbered = number_within(rest, "length", "number")
    schema = "length bigint, first bigint, last bigint, sequence bigint, `offset` bigint"
    # at most a few combinations for each length: bounded by the window, whatever the input
    by_length = spark.createDataFrame(places, schema).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "sequence", "offset"))).alias("places"))
    placed = numbered.join(F.broadcast(by_length), "length", "left")
    place = F.get(F.filter("places", lambda x: (x["first"] <= F.col("number")) & (F.col("number") < x["last"])), F.lit(0))
    placed = cut(placed.withColumn("_place", place).drop("places"))
    whole = placed.filter(F.col("_place").isNotNull()).select(
        "doc", "start", "length", "crc", "tokens", F.lit(1).alias("family"), (F.col("_place.sequence") + F.col("number") - F.col("_place.first")).alias("sequence"), F.col("_place.offset").alias("offset")
    )
    left_over = placed.filter(F.col("_place").isNull()).select("doc", "start", "ids", "tokens")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, turn, filled = TaskContext.get().partitionId() << 33, 0, 0
        tail: list[tuple] = []  # pieces of the sequence being filled, as (doc, start, ids, tokens, offset)

        def made(rows: list[tuple], sequence: int) -> list[tuple]:
            return [(doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, 2, base + sequence, offset) for doc, start, ids, tokens, offset in rows]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2, strict=True)], named)

        for batch in batches:
            out: list[tuple] = []
            for doc, start, packed, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(zlib.decompress(packed), "<u4")
                while len(ids):
                    piece = ids[: window - filled]
                    tail.append((doc, start, piece, tokens, filled))
                    filled, start, ids = filled + len(piece), start + len(piece), ids[len(piece) :]
                    if filled == window:
                        out += made(tail, turn)
                        tail, turn, filled = [], turn + 1, 0
            if out:
                yield batch_of(out)
        while tail:  # the last sequence: its largest power of two first
            room, filled, out, rest_of = 1 << (filled.bit_length() - 1), filled - (1 << (filled.bit_length() - 1)), [], []
            used = moved = 0
            for doc, start, ids, tokens, _ in tail:
                take = min(len(ids), room - used)
                if take:
                    out.append((doc, start, ids[:take], tokens, used))
                    used += take
                if take < len(ids):
                    rest_of.append((doc, start + take, ids[take:], tokens, moved))
                    moved += len(ids) - take
            yield batch_of(made(out, turn))
            tail, turn = rest_of, turn + 1

    greedy_schema = "doc bigint, start bigint, length bigint, crc bigint, tokens bigint, family int, sequence bigint, `offset` bigint"
    pieces = full.select(named).unionByName(whole.select(named)).unionByName(left_over.mapInArrow(greedy, greedy_schema))
    return pieces.select(
        F.col("doc").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.col("sequence") * 3 + F.col("family")).alias("sequence_id"), "offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), window=2048)


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
