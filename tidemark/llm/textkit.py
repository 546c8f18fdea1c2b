"""Vectorised helpers that run inside Arrow tasks: batches of texts as bytes, words and hashes.

A task sees its documents as one byte buffer with offsets. Buffers are cut into pieces of a few
MB, at document boundaries, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.session import ship

PIECE_BYTES = 1 << 19
LONG_RANGE = 256
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Piece:
    """Some documents of a batch: row numbers in the batch, bytes, and offsets (n + 1)."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.rows)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Null texts count as empty. A text longer than the limit is a piece of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Piece(np.arange(i, j), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; those for an ordinary piece are kept."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 2 * PIECE_BYTES:
            _powers[int(base)] = known
    return known[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for each range; values are uint64 codes.

    A polynomial modulo 2 ** 64 gives equal hashes to some long patterned sequences whatever its
    base, so ranges over LONG_RANGE values are hashed by xxHash instead.
    """
    base = BASES[which]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=total[1:])
    back = powers(len(values) + 1, inverse(base))
    out = mix((total[ends] - total[starts]) * back[starts] + mix((ends - starts).astype(np.uint64) + U64(which)))
    for i in np.flatnonzero(ends - starts > LONG_RANGE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(values[starts[i] : ends[i]], which)
    return out


def row_names(matrix: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes, a column at a time."""
    out = np.full(len(matrix), U64(matrix.shape[1]), np.uint64)
    for column in matrix.T:
        out = (out + BYTE_CODES[column]) * BASES[0]
    return mix(out)


class Words:
    """Maximal runs of bytes outside `space`, in order; doc is the row in the piece."""

    def __init__(self, piece: Piece, space: np.ndarray = SPACE):
        inside = ~space[piece.data]
        edge = np.empty(len(inside) + 1, bool)
        if len(inside):
            edge[0], edge[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        else:
            edge[:] = False
        cuts = piece.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        cuts = np.unique(cuts[inside[cuts - 1] & inside[cuts]]) if len(cuts) else cuts
        at = np.flatnonzero(edge)
        starts, ends = at[0::2], at[1::2]
        if len(cuts):  # a word that ends one text, and one that starts the next
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, piece.offsets)  # word range of document i: first[i]:first[i+1]
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(piece)), self.counts)

    def hashes(self, data: np.ndarray, which: int = 0) -> np.ndarray:
        return range_hash(BYTE_CODES[data], self.starts, self.ends, which)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of `width` consecutive items inside each document, and the documents."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc], doc


def covered(starts: np.ndarray, width, n: int) -> np.ndarray:
    """Which of n positions lie in [start, start + width) of some start."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + width, -1)
    return np.cumsum(delta[:n]) > 0


def give_back() -> None:
    """Return freed memory to the system; a worker that keeps it counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every libc has it
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def doc_keys(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
