"""Packed postings: few rows of compressed columns instead of a Spark row for each posting.

A posting belongs to a hash part (where equal keys meet) or to a document part (where results
meet their documents). Parts are even because they are dealt by hash; keys that are hot inside
one task are combined before they are packed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import give_back, mix
from tidemark.session import ship

U64 = np.uint64


GROUP_BYTES = (2 << 20, 32 << 20)
SMALL_CORPUS = 1 << 30


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0


def n_parts(size: int, least: int = 64) -> int:
    """Parts for `size` bytes of text. What meets in a group grows with the square root of the corpus
    between the two GROUP_BYTES, so that neither a group's memory nor the number of messages from
    tasks to parts gets out of hand."""
    low, high = GROUP_BYTES
    group = min(max(low, int(low * (size / SMALL_CORPUS) ** 0.5)), high)
    return max(least, size // group) | 1


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """A column as zstandard-compressed byte planes; sorted columns as differences."""
    a = np.ascontiguousarray(a)
    if delta and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize * int(np.prod(a.shape[1:]))).T.tobytes())


def unpack(b: bytes, kind, delta: bool = False, width: int = 1) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    rows = np.ascontiguousarray(flat.reshape(kind.itemsize * width, -1).T)
    out = rows.view(kind).reshape(-1) if width == 1 else rows.view(kind).reshape(-1, width)
    return np.cumsum(out, dtype=kind) if delta else out


def with_doc_part(docs: DataFrame, parts: int, text: str = "text") -> DataFrame:
    """part, doc (a null id counts as the smallest), doc_id, text, and key and tag: 79 bits of hash
    of id and text together. Rows are dealt to parts by key, so that rows without an id, with one id
    or with ids of one stride spread like all others."""
    doc = docs["doc_id"].cast("long")
    key = F.xxhash64(doc, docs[text])
    return docs.select(
        F.pmod(key, F.lit(parts)).cast("int").alias("part"), F.coalesce(doc, F.lit(-(1 << 62))).alias("doc"), doc.alias("doc_id"), docs[text].alias("text"),
        key.alias("key"), F.pmod(F.hash(docs[text], doc), F.lit(1 << 15)).cast("short").alias("tag"),
    )


def split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, row numbers) of the parts that occur, rows in their order."""
    order = np.argsort(part, kind="stable")
    starts = group_starts(part[order])
    for s, e in zip(starts.tolist(), np.append(starts, len(part))[1:].tolist(), strict=True):
        yield int(part[order[s]]), order[s:e]


def hash_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Even parts of sorted hashes: by their upper bits, so that parts are runs of the order."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def grouped(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        give_back()
        return fn(table)

    return df.groupBy("part").applyInArrow(run, schema)


def meet(docs: DataFrame, postings: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Documents and their postings, part by part."""
    ship(docs.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        return fn(left, right)

    return docs.groupBy("part").cogroup(postings.groupBy("part")).applyInArrow(run, schema)


def rows_of(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """values of groups at starts, repeated for the n rows of the groups."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def doc_salt(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) + U64(0x5851F42D4C957F2D))
