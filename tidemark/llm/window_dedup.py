"""Removal of repeated word windows behind a count-min prefilter.

A word is removed when a window of WINDOW words that covers it occurs anywhere else, in its own
document too. The first pass counts every window in count-min sketches of ROWS rows, one a task
(as the cells that are not zero), which are merged by ranges of cells. The least of a window's
cells is never below its count, so a window whose estimate is one occurs once. The merged sketch
is sent to the tasks as one bit a cell ("two or more"). The second pass groups only the windows
estimated repeated, by 96 bits of hash, and marks those that do repeat; a window that repeats is
estimated repeated, so none is lost.

A row has about a cell for two bytes of text, 2 ** MOST_BITS at most (ROWS times 32 MB of bits).
Beyond about half a billion windows the filter lets more single windows pass, at the extreme all,
and the second pass groups these as well: its cost is linear, its result the same.

Hot windows: a task sends a window once, with the number it has seen, and marks its own repeats.

Nulls: a null text has no words. Rows with equal ids are separate documents for counting, so a
repeated row loses its windows in both. Texts with fewer than WINDOW words lose nothing. An empty
table gives an empty table. Columns other than doc_id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.packed import group_starts, grouped, hash_part, meet, n_parts, pack, rows_of, split_by, spread, text_bytes, unpack, with_doc_part
from tidemark.llm.suffix_dedup import _arrow
from tidemark.llm.textkit import Words, covered, map_batches, mix, pieces, range_hash, windows

WINDOW = 35
ROWS = 2
LEAST_BITS, MOST_BITS = 16, 28
TASK_WINDOWS = 2_000_000
U64 = np.uint64
SALTS = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))  # one a row

_SKETCH = "part int, cells binary, counts binary"
_MERGED = "part int, bits binary"
_SEEN = "part int, names binary, checks binary, counts binary, keys binary, tags binary, places binary, own_keys binary, own_tags binary, own_places binary"
_MARKS = "part int, keys binary, tags binary, places binary"


class Sketch:
    """Shape of a count-min sketch: ROWS rows of 2 ** bits cells, cut into `parts` slices."""

    def __init__(self, size: int, parts: int):
        self.bits = min(max(LEAST_BITS, (size // 2).bit_length()), MOST_BITS)
        self.parts = parts
        self.slice = -(-(ROWS << self.bits) // parts // 8) * 8 + 8  # whole bytes of bits

    def cells(self, code: np.ndarray, row: int) -> np.ndarray:
        return (mix(code ^ SALTS[row]) >> U64(64 - self.bits)) + U64(row << self.bits)

    def slices_of(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(slice, cells, counts) of the cells that these windows touch."""
        for row in range(ROWS):
            cells, counts = np.unique(self.cells(codes, row), return_counts=True)
            for p, r in split_by((cells // U64(self.slice)).astype(np.int64)):
                yield p, cells[r], np.minimum(counts[r], 255).astype(np.uint8)

    def merged(self, part: int, sent: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Bits of a slice: cells whose counts add up to two or more."""
        total = np.zeros(self.slice, np.uint8)
        for cells, counts in sent:
            i = (cells - U64(part * self.slice)).astype(np.int64)
            total[i] = np.minimum(total[i].astype(np.int64) + counts, 2)
        return np.packbits(total > 1)

    def whole(self, slices: dict[int, np.ndarray]) -> np.ndarray:
        out = np.zeros(self.parts * self.slice // 8, np.uint8)
        for p, bits in slices.items():
            out[p * self.slice // 8 : (p + 1) * self.slice // 8] = bits
        return out

    def repeated(self, code: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Windows whose least count may be two or more."""
        out = np.ones(len(code), bool)
        for row in range(ROWS):
            open_ = np.flatnonzero(out)
            cell = self.cells(code[open_], row).astype(np.int64)
            out[open_] = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
        return out


def task_sketches(docs: DataFrame, shape: Sketch) -> DataFrame:
    """Counts by cell of every window, a set of slices for each task."""

    def rows(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"part": [], "cells": [], "counts": []}
        for p, cells, counts in shape.slices_of(np.concatenate(codes)):
            out["part"].append(p)
            out["cells"].append(pack(cells, True))
            out["counts"].append(pack(counts))
        yield from rows_of(out, _arrow(_SKETCH)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in pieces(batch.column("text")):
                words = Words(piece)
                at, _ = windows(words.first, WINDOW)
                held.append(range_hash(words.hashes(piece.data), at, at + WINDOW))
                n += len(at)
                if n > TASK_WINDOWS:
                    yield from rows(held)
                    held, n = [], 0
        if n:
            yield from rows(held)

    return map_batches(docs.select("text"), run, _SKETCH)


def merged_sketch(sketches: DataFrame, shape: Sketch) -> DataFrame:
    """One bit a cell: counted twice or more over all tasks. A row a slice."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        sent = ((unpack(cells.as_py(), np.uint64, True), unpack(counts.as_py(), np.uint8)) for cells, counts in zip(table["cells"], table["counts"], strict=True))
        bits = zstandard.ZstdCompressor(level=1).compress(shape.merged(part, sent).tobytes())
        return rows_of({"part": [part], "bits": [bits]}, _arrow(_MERGED))

    return grouped(sketches, run, _MERGED)


def candidate_windows(docs: DataFrame, sketch, shape: Sketch, parts: int) -> DataFrame:
    """Windows estimated repeated, once a task, with their counts; own repeats are marked here."""

    def rows(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        name, check, key, tag, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((check, name))
        name, check, key, tag, place = name[order], check[order], key[order], tag[order], place[order]
        starts = group_starts(name, check)
        counts = np.diff(np.append(starts, len(name)))
        own = np.flatnonzero(spread(counts, starts, len(name)) > 1)
        schema = _arrow(_SEEN)
        out: dict[str, list] = {f.name: [] for f in schema}
        n = np.minimum(counts, 255).astype(np.uint8)
        split = list(split_by(hash_part(name[starts], parts)))
        for (p, r), o in zip(split, np.array_split(own, len(split)), strict=True):  # marks travel in even shares
            s = starts[r]
            values = [p, pack(name[s], True), pack(check[s]), pack(n[r]), pack(key[s]), pack(tag[s]), pack(place[s]), pack(key[o]), pack(tag[o]), pack(place[o])]
            for column, value in zip(schema.names, values, strict=True):
                out[column].append(value)
        yield from rows_of(out, schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shape.whole({p: np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8) for p, b in sketch.value.items()})
        found, held = [], 0
        for batch in batches:
            key, tag = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
            for piece in pieces(batch.column("text")):
                words = Words(piece)
                at, row = windows(words.first, WINDOW)
                code = range_hash(words.hashes(piece.data), at, at + WINDOW)
                hit = shape.repeated(code, bits)
                at, row, code = at[hit], row[hit], code[hit]
                if not len(at):
                    continue
                check = (range_hash(words.hashes(piece.data, 1), at, at + WINDOW, 1) >> U64(32)).astype(np.uint32)
                found.append([code, check, key[piece.rows[row]], tag[piece.rows[row]], (at - words.first[row]).astype(np.int64)])
                held += len(at)
                if held > TASK_WINDOWS:
                    yield from rows(found)
                    found, held = [], 0
        if held:
            yield from rows(found)

    return map_batches(docs.select("key", "tag", "text"), run, _SEEN)


def repeated_windows(seen: DataFrame, parts: int) -> DataFrame:
    """Exact groups of a part; the windows that do repeat, by the part of their document."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c, kind, delta=False: np.concatenate([unpack(x.as_py(), kind, delta) for x in table[c]])
        name, check, count = col("names", np.uint64, True), col("checks", np.uint32), col("counts", np.uint8).astype(np.int64)
        order = np.lexsort((check, name))
        starts = group_starts(name[order], check[order])
        total = np.empty(len(name), np.int64)
        total[order] = spread(np.add.reduceat(count[order], starts), starts, len(name))
        hit = (total > 1) & (count == 1)  # the task that saw it more often has marked it
        key, tag, place = (np.concatenate([col(a, kind)[hit], col(f"own_{a}", kind)]) for a, kind in (("keys", np.int64), ("tags", np.int16), ("places", np.int64)))
        order = np.lexsort((place, tag, key))
        key, tag, place = key[order], tag[order], place[order]
        schema = _arrow(_MARKS)
        out: dict[str, list] = {f.name: [] for f in schema}
        for p, r in split_by(key % parts):  # as in with_doc_part()
            for column, value in zip(schema.names, [p, pack(key[r], True), pack(tag[r]), pack(place[r])], strict=True):
                out[column].append(value)
        return rows_of(out, schema)

    return grouped(seen, run, _MARKS)


def removed_words(docs: DataFrame, marks: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, tag = left["key"].to_numpy(), left["tag"].to_numpy()
        col = lambda c, kind, delta=False: np.concatenate([np.zeros(0, kind), *(unpack(x.as_py(), kind, delta) for x in right[c])])
        who, which, place = col("keys", np.int64, True), col("tags", np.int16), col("places", np.int64)
        order = np.argsort(who, kind="stable")
        who, which, place = who[order], which[order], place[order]
        los, his = np.searchsorted(who, key, "left"), np.searchsorted(who, key, "right")
        out: dict[str, list] = {f.name: [] for f in schema}
        for texts in left["text"].chunks:
            base = len(out["n_words"])
            for piece in pieces(texts):
                words = Words(piece)
                for i, row in enumerate(piece.rows + base):
                    first, n = words.first[i], int(words.counts[i])
                    mine = slice(los[row], his[row])
                    at = place[mine][which[mine] == tag[row]]
                    at = at[at <= n - WINDOW]
                    keep = ~covered(at, WINDOW, n) if len(at) else np.ones(n, bool)
                    starts, ends = words.starts[first : first + n][keep], words.ends[first : first + n][keep]
                    left_ = b" ".join(piece.data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
                    out["n_words"].append(n)
                    out["n_removed"].append(n - int(keep.sum()))
                    out["kept_sha256"].append(hashlib.sha256(left_).hexdigest())
        out["doc_id"] = left["doc_id"].to_pylist()
        return rows_of(out, schema)

    return meet(docs, marks, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    size = text_bytes(docs, text)
    parts = n_parts(size)
    shape = Sketch(size, parts)
    rows = with_doc_part(docs, parts, text)
    merged = merged_sketch(task_sketches(rows, shape), shape).collect()  # at most ROWS << MOST_BITS bits
    sketch = docs.sparkSession.sparkContext.broadcast({r.part: bytes(r.bits) for r in merged})
    marks = repeated_windows(candidate_windows(rows, sketch, shape, parts), parts)
    return removed_words(rows.select("part", "key", "tag", "doc_id", "text"), marks)


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over documents: WINDOW words, everything as the module says of nulls, ties and empty tables."""
    return dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
