"""Hashed word shingles of whole texts and their minhash signatures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

U64 = np.uint64
#: Words whose hashes a task remembers before it starts anew.
REMEMBERED = 1 << 17


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Shingler:
    """Sets of the distinct shingles of texts, as sorted unsigned 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self.factors = np.random.default_rng(width).integers(1, 1 << 63, width, np.int64).astype(U64) * U64(2) + U64(1)
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), U64, len(words))

    def shingles(self, text: bytes | None) -> np.ndarray:
        """The set of a UTF-8 text: A-Z lower-cased, words between ASCII white space; fewer words than the width are one shingle."""
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, U64)
        hashes = self.word_hashes(words)
        n = min(self.width, len(words))
        total = np.full(len(words) - n + 1, n, U64)
        for at in range(n):
            total += hashes[at : at + len(total)] * self.factors[at]
        return np.unique(scramble(total))


def set_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        first, second = scramble(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), scramble(shingles * U64(0x14057B7EF767814F)).sum(dtype=U64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


@dataclass(frozen=True)
class Bands:
    """A family of universal hash functions, and how their minima are banded."""

    rows: int
    count: int

    @classmethod
    def for_threshold(cls, threshold: float, rows: int = 6, miss: float = 1e-6) -> Bands:
        """As many bands as let a pair at the threshold share none with at most the probability miss."""
        return cls(rows, int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows)))))

    @property
    def hashes(self) -> int:
        return self.rows * self.count

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd factors and offsets of x -> factor * x + offset modulo 2**64, of which the upper bits count."""
        drawn = np.random.default_rng(self.hashes).integers(0, 1 << 63, (2, self.hashes), np.int64).astype(U64)
        return drawn[0] * U64(2) + U64(1), drawn[1] * U64(2)

    def signature(self, shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        factors, offsets = functions
        least = np.full(self.hashes, np.iinfo(U64).max, U64)
        for at in range(0, len(shingles), 256):
            np.minimum(least, (shingles[at : at + 256, None] * factors + offsets).min(axis=0), out=least)
        return least >> U64(32)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One signed 64-bit bucket key for each band."""
        parts = signature.reshape(self.count, self.rows)
        key = np.arange(1, self.count + 1, dtype=U64)
        for at in range(self.rows):
            key = scramble(key * U64(0x9E3779B97F4A7C15) + parts[:, at])
        return key.view(np.int64)
