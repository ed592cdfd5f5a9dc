"""Hashes of words and windows, and filters of hashed keys of a fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
OTHER = np.uint64(0x2545F4914F6CDD1D)

#: Keys that a filter takes at most, and its bits; with more keys operators join by a shuffle instead.
FILTER_KEYS, FILTER_BITS = 1 << 23, 27


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def prefix_hashes(values: np.ndarray, base: np.uint64 = STEP) -> np.ndarray:
    """Polynomial hashes of all prefixes, with ``between`` for any range of a bounded length.

    The base is odd, so the recurrence is a cumulative sum of values times falling powers.
    """
    n = len(values)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    falling = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, inverse, np.uint64), out=falling[1:])
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * falling[1:], dtype=np.uint64, out=out[1:])
    rising = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, base, np.uint64), out=rising[1:])
    return out, rising


def between(prefixes: tuple[np.ndarray, np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [begin, end): equal for equal values, wherever they stand."""
    sums, rising = prefixes
    return mixed((sums[end] - sums[begin]) * rising[end] + (end - begin).astype(np.uint64) * OTHER)


class Filter:
    """Set of 64-bit keys in a fixed number of bits: it may say yes for a key that isn't there, never no for one that is."""

    def __init__(self, bits: int = FILTER_BITS):
        self.bits, self.map = bits, np.zeros(1 << (bits - 3), np.uint8)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys.view(np.uint64) * OTHER) >> np.uint64(64 - self.bits)

    def add(self, keys: np.ndarray) -> None:
        at = self._places(keys)
        np.bitwise_or.at(self.map, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        return (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def token(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit key for the values of several columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mixed(out * STEP + np.ascontiguousarray(c).view(np.uint64))
    return out


def key_filter(keys: DataFrame, most: int = FILTER_KEYS) -> Filter | None:
    """A filter of the tokens of a stored table of long columns; none if there are more than ``most``."""
    if keys.count() > most:
        return None
    out = Filter()
    for batch in keys.toArrow().to_batches():
        out.add(token(*[c.to_numpy() for c in batch.columns]))
    return out


def chunk_ends(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def list_of(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))
