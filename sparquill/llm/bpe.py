"""Byte-level BPE by a segment tree.

A piece of text (one match of the splitting pattern) is a row of bytes. The segment tree stands over
the byte positions; a leaf holds the rank of the pair that starts there together with the position,
an inner node the smaller of its two children, so the root is the leftmost pair of the lowest rank.
A merge changes three leaves (the merged pair, the swallowed one, the left neighbour), each in
logarithmic time, so a piece of n bytes costs O(n log n) however long it is.

Edge cases: a null or empty text has no ids; the empty list decodes to no bytes; null ids decode as
the empty list; an unknown id raises ValueError; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Pieces in each of the two generations that a Python worker remembers, and the longest piece that is remembered.
MEMO_PIECES, MEMO_BYTES = 350_000, 64
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: base64 token and rank on each line. Runs on the driver; the table has a fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def _put(tree: list[int], p: int, value: int) -> None:
    """Change a leaf and the nodes above it, as far as they change."""
    tree[p] = value
    while p > 1:
        other = tree[p ^ 1]
        if other < value:
            value = other
        p >>= 1
        if tree[p] == value:
            return
        tree[p] = value


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        raise ValueError(f"no rank for the byte {piece!r}")
    width = n - 1
    bits = n.bit_length()
    mask = (1 << bits) - 1
    get = ranks.get
    tree = [NONE] * width
    for i in range(width):
        r = get(piece[i : i + 2])
        tree.append(NONE if r is None else r << bits | i)
    for p in range(width - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    after = list(range(1, n + 2))  # where the token that starts here ends
    before = list(range(-1, n))  # where the token before it starts
    while (least := tree[1]) != NONE:
        i = least & mask
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        if j < width:
            _put(tree, width + j, NONE)
        r = get(piece[i : after[k]]) if k < n else None
        _put(tree, width + i, NONE if r is None else r << bits | i)
        if i:
            h = before[i]
            r = get(piece[h:k])
            _put(tree, width + h, NONE if r is None else r << bits | h)
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class _Memo(dict):
    """Piece to packed ids, in two generations: when the young one is full it becomes the old one, and what is asked for again moves back. A worker's memory stays bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            raw = piece.encode("utf-8", "replace")
            ids = merge(raw, self.ranks)
            packed = pack(f"{len(ids)}i", *ids) if len(ids) < 64 else np.array(ids, np.int32).tobytes()
            if len(raw) > MEMO_BYTES:
                return packed
        if len(self) >= MEMO_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


def _encoder(ranks: dict[bytes, int], pattern: str):
    memo, find = _Memo(ranks), regex.compile(pattern).findall

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        packed = [b"".join(map(memo.__getitem__, find(t))) if t else b"" for t in columns[0].to_pylist()]
        ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))]

    return work


def _decoder(ranks: dict[bytes, int]):
    vocabulary: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, r in ranks.items():
        vocabulary[r] = token
    tokens = pa.array(vocabulary, pa.binary())

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        ids = columns[0]
        flat = ids.flatten()
        try:
            pieces = tokens.take(flat)
        except pa.ArrowInvalid as e:
            raise ValueError(f"an id is not in the vocabulary: {e}") from e
        if pieces.null_count:
            raise ValueError("an id is null or not in the vocabulary")
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        marks = np.concatenate([[0], np.cumsum(lengths)])
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :][marks] if len(flat) else np.zeros(len(marks), np.int32)
        body = pieces.buffers()[2] or pa.py_buffer(b"")
        return [pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32).tobytes()), body])]

    return work


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` array<int>: the ids of the whole text, each match of ``pattern`` merged by itself."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)]
    return common.append_arrow(df, [text_col], lambda: _encoder(shared.value, pattern), fields)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col`` binary: the bytes that the ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    fields = [T.StructField(bytes_col, T.BinaryType(), False)]
    return common.append_arrow(df, [ids_col], lambda: _decoder(shared.value), fields)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(bytes_col, T.BinaryType(), False)]

    def make():
        there, back = _encoder(shared.value, pattern), _decoder(shared.value)

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            ids = there(columns)
            return ids + back(ids)

        return work

    return common.append_arrow(df, [text_col], make, fields)
