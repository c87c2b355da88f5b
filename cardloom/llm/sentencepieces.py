"""SentencePiece encoding with source offsets, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.text import text_or_empty
from cardloom.session import table

#: Fixed value: how the models write a space.
SPACE_MARK = "▁"
#: Stretches between places where no merge can cross: marks, then the letters that follow them.
STRETCH = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
#: Letters of stretches whose pieces a worker remembers before it starts anew.
REMEMBERED = 1 << 22
#: Tokens that one Arrow batch of results holds, or one document if that has more.
BATCH_TOKENS = 1 << 19


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 keys, then the replacements, each ended by a zero byte.

    The trie's units are 32 bits: a label, the offset to the children, and whether a value hangs below.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        firsts = "".join(re.escape(c) for c in self.first_characters())
        #: Finds the places where a key may begin; between them a text stands for itself.
        self.starts = re.compile(f"[{firsts}]") if firsts else None

    @staticmethod
    def children(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def child(self, node: int, byte: int) -> int | None:
        """The node below node for a byte, with the place of its children; None if there is none."""
        at = node ^ byte
        if at >= len(self.units) or self.units[at] & ((1 << 31) | 0xFF) != byte:
            return None
        return at

    def first_characters(self) -> list[str]:
        """The characters that begin a key, read off the trie's upper levels."""
        if not self.units:
            return []
        found, open_ = [], [(b"", self.children(self.units[0]))]
        while open_:
            prefix, node = open_.pop()
            for byte in range(0x80, 0xC0) if prefix else range(256):
                at = self.child(node, byte)
                if at is None or (not prefix and 0x80 <= byte < 0xC0):
                    continue
                grown = prefix + bytes([byte])
                try:
                    found.append(grown.decode())
                except UnicodeDecodeError:
                    if len(grown) < 4:
                        open_.append((grown, at ^ self.children(self.units[at])))
        return found

    def longest(self, text: bytes, at: int) -> tuple[int, str] | None:
        """The bytes of the longest key that text holds at a place, and what replaces it."""
        node, found = self.children(self.units[0]), None
        for end in range(at, len(text)):
            below = self.child(node, text[end])
            if below is None:
                break
            node = below ^ self.children(self.units[below])
            if self.units[below] >> 8 & 1:
                found = end + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])].decode()


def source_offsets(text: str) -> np.ndarray:
    """Where each character of a text begins in its UTF-8 bytes, and where the last one ends."""
    if text.isascii():
        return np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])


class Pieces:
    """Encodes by a BPE model file of the sentencepiece library with byte fallback, keeping source offsets.

    Texts are normalised here, with the source of every character. No merge crosses from a letter
    to a mark, so the library merges each distinct stretch once, without a normaliser of its own.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto.FromString(self.processor.serialized_model_proto())
        kinds = model_pb2.ModelProto.SentencePiece
        trainer, rules = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != model_pb2.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not rules.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and marks before words are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in model.pieces):
            raise ValueError("models whose pieces hold a mark after a letter are not supported")
        self.end_id = self.processor.eos_id()
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy_prefix, self.one_space = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.width = [len(p.piece) if p.type == kinds.NORMAL else 0 for p in model.pieces]
        self.byte_of = {at: int(p.piece[1:-1], 16) for at, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        # the same merges with the normaliser switched off: what they are given is normal
        rules.CopyFrom(model_pb2.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=True))
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0  # letters of the stretches that are known

    def normalise(self, source: str) -> tuple[str, np.ndarray]:
        """The normalised text, and where in the source's bytes each of its characters begins and the last one ends.

        The longest key at each place is replaced, extra spaces go if the model says so, and spaces
        become marks. All characters of a replacement begin where its key does.
        """
        text, begins = source, source_offsets(source)
        if self.map.starts and self.map.starts.search(source):
            text, begins = self.replaced(source, begins)
        if self.one_space:
            text, begins = self.single_spaced(text, begins)
        if self.dummy_prefix and (text if self.one_space else source):
            text, begins = " " + text, np.concatenate([[self.spaces_in_front(source) if self.one_space else 0], begins])
        return text.replace(" ", SPACE_MARK), begins

    def replaced(self, source: str, begins: np.ndarray) -> tuple[str, np.ndarray]:
        body = source.encode()
        letters: list[str] = []
        places: list[np.ndarray] = []
        done = 0  # characters of the source that are dealt with
        for start in self.map.starts.finditer(source):
            at = start.start()
            hit = self.map.longest(body, int(begins[at])) if at >= done else None
            if hit is None:
                continue
            width, text = hit
            letters += [source[done:at], text]
            places += [begins[done:at], np.full(len(text), begins[at])]
            done = int(np.searchsorted(begins, begins[at] + width))
        return "".join(letters) + source[done:], np.concatenate([*places, begins[done:]])

    def spaces_in_front(self, source: str) -> int:
        """The bytes in front of a text that stand for spaces."""
        body, at = source.encode(), 0
        while at < len(body):
            width, text = (self.map.units and self.map.longest(body, at)) or (1, chr(body[at]))
            if text != " ":
                break
            at += width
        return at

    @staticmethod
    def single_spaced(text: str, begins: np.ndarray) -> tuple[str, np.ndarray]:
        """Without spaces in front and after a space, and without spaces and marks at the end."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        space = codes == 0x20
        last = np.flatnonzero(~space & (codes != ord(SPACE_MARK)))
        end = int(last[-1]) + 1 if len(last) else 0
        kept = np.flatnonzero(~space[:end] | ~np.concatenate([[True], space])[:end])
        return codes[kept].tobytes().decode("utf-32-le"), begins[np.append(kept, end)]

    def learn(self, stretches: list[str]) -> None:
        """Remember the ids of stretches, and the characters of each id; a character spelled in bytes counts with the last of them."""
        for stretch, ids in zip(stretches, self.merges.encode(stretches, num_threads=1), strict=True):
            widths = bytearray(map(self.width.__getitem__, ids))
            left = 0  # bytes that the character being spelled still lacks
            for at in [at for at, width in enumerate(widths) if not width]:
                value = self.byte_of[ids[at]]
                left = left - 1 if left else (value >= 0xC0) + (value >= 0xE0) + (value >= 0xF0)
                widths[at] = not left
            self.known[stretch] = array("i", ids).tobytes(), bytes(widths)
            self.held += len(stretch)

    def encode(self, source: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where each piece begins and ends in the source's UTF-8 bytes; no end id."""
        text, places = self.normalise(source)
        stretches = STRETCH.findall(text)
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        unknown = [s for s in set(stretches) if s not in self.known]
        if unknown:
            self.learn(unknown)
        parts = list(map(self.known.__getitem__, stretches))
        ids = np.frombuffer(b"".join([p[0] for p in parts]), np.int32)
        widths = np.frombuffer(b"".join([p[1] for p in parts]), np.uint8)
        after = np.cumsum(widths, dtype=np.int64)
        return ids, places[after - widths], places[after]


@cache
def pieces_of(path: str) -> Pieces:
    """One encoder for each worker process, so that its tasks share what it remembers."""
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, end: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, begins, ends: the pieces of whole texts and the source bytes that each stands for.

    begins and ends are offsets in the text's UTF-8 bytes, as the library's own: text[begins[i]:ends[i]]
    gave piece i, and the spans follow each other without overlap. Of the pieces of one replaced key, as of
    the bytes of one spelled-out character, the last spans it and the others nothing, at its begin;
    the mark in front of a text and the end id span nothing. A null text counts as empty and has the end id alone. Very long texts are encoded
    whole, however long a word is. Repeated rows and null ids are encoded like others; an empty
    table gives an empty one. Pieces of equal score merge from the left. Other columns are not read,
    so clashing names do no harm. Rows don't depend on each other and nothing is shuffled.
    """
    path = model or default_model()
    kind = docs.schema[key].dataType.simpleString()
    names = ["_key", "ids", "begins", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        last = [pieces.end_id] if end else []

        def result(keys: pa.Array, columns: list[list[np.ndarray]]) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in columns[0]])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate(c).astype(np.int32)) for c in columns]
            return pa.RecordBatch.from_arrays([keys, *lists], names)

        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            start = held = 0
            for at in range(batch.num_rows):
                source = batch.column(1)[at].as_py()
                ids, begins, ends = pieces.encode(source)
                size = [len(source.encode())] * len(last)
                for column, values, tail in zip(columns, (ids, begins, ends), (last, size, size), strict=True):
                    column.append(np.concatenate([values, np.array(tail, np.int64)]) if tail else values)
                held += len(ids) + 1
                if held >= BATCH_TOKENS:
                    yield result(batch.column(0).slice(start, at + 1 - start), columns)
                    columns, start, held = [[], [], []], at + 1, 0
            if columns[0]:
                yield result(batch.column(0).slice(start), columns)

    narrow = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    return narrow.mapInArrow(run, f"_key {kind}, ids array<int>, begins array<int>, ends array<int>").withColumnRenamed("_key", key)


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text that the library's decode(ids) gives; null ids give a null text, no ids an empty one. A column named as the new one is replaced."""
    path = model or default_model()

    @F.pandas_udf("string")
    def texts(batch):
        processor = pieces_of(path).processor
        return batch.map(lambda x: None if x is None else processor.decode(x.tolist()))

    return encoded.withColumn(into, texts(ids))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with an end id and decoded again."""
    found = decode(encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op11_sentencepiece": op11_sentencepiece}
ORACLES: dict[str, str] = {}
