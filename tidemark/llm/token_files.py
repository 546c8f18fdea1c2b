"""Token files: ids in fixed-size blocks, transposed to bit or byte planes, each compressed.

A file is a Parquet file of chunks in ascending order. A chunk holds whole documents: their ids
with the end id after each, cut into blocks of BLOCK ids; the bytes (or bits) of equal place of a
block's ids form a plane, each plane is compressed with zstandard on its own, and planes lie one
after another in `payload`. The chunk index says where: `ends` has the end of each plane, block
by block; `docs` and `lengths` list the documents; `start` counts the ids of the part before.
Parts are ranges of doc_id in ascending order, so files in order of part hold ascending ids.

Tokenising. A text may be cut before a space that a visible character follows, and between an
ASCII letter and a mark, for the tokenizer's own rules cut there too; so equal pieces are encoded once and their ids looked up by
64 bits of hash. The bytes of a piece are compared with those whose ids it is to get; a batch in which
two different pieces share a hash goes to the tokenizer as it is. The queries call the tokenizer as it is: the string of a special token in a text
gives that token's id, and no cut falls within it. With `special=False`, the default of the
functions, such strings are ordinary text.

Nulls: a null text is empty (only the end id); a null doc_id comes first. Rows that repeat an id
lie in order of their text's hash. Empty tables give no files' rows and empty results.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.textkit import BYTE_CODES, Piece, map_batches, pieces, range_hash
from tidemark.session import scratch

END_ID = 2
BLOCK = 1 << 16
CHUNK_IDS = 1 << 19
CACHE_PIECES = 1_500_000
KEEP_PIECES = 400_000  # some 40 MB
LATELY = 60_000
PIECE = 1 << 20
U64 = np.uint64

CHUNKS = "part int, chunk int, start long, n_ids long, mode string, docs array<long>, lengths array<long>, ends array<long>, payload binary"

# lead bytes that cannot begin a white-space character: visible ASCII, and UTF-8 leads but for
# those of U+0080-U+00BF and of the planes with other kinds of space
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)  # visible ASCII but letters, digits and the apostrophe
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True


def planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block, low bytes or bits first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(len(ids), 4)
    if mode == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def unplanes(parts: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], 1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def encode_chunk(ids: np.ndarray, mode: str = "byte", block: int = BLOCK) -> tuple[bytes, list[int]]:
    """Payload and plane ends of a chunk."""
    press = zstandard.ZstdCompressor(level=3)
    out, ends, at = [], [], 0
    for i in range(0, len(ids), block):
        for plane in planes(ids[i : i + block], mode):
            out.append(press.compress(plane))
            at += len(out[-1])
            ends.append(at)
    return b"".join(out), ends


def decode_chunk(payload: bytes, ends: list[int], n: int, mode: str = "byte", block: int = BLOCK) -> np.ndarray:
    per = 4 if mode == "byte" else 32
    open_ = zstandard.ZstdDecompressor()
    starts = [0, *ends[:-1]]
    out = [np.zeros(0, "<u4")]
    for b in range(len(ends) // per):
        parts = [open_.decompress(payload[s:e]) for s, e in zip(starts[b * per : (b + 1) * per], ends[b * per : (b + 1) * per], strict=True)]
        out.append(unplanes(parts, min(block, n - b * block), mode))
    return np.concatenate(out)


def _same_bytes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, b: np.ndarray, other: np.ndarray, other_ends: np.ndarray) -> bool:
    """Whether a[start:end] equals b[other:other_end] for all ranges."""
    n = ends - starts
    if (n != other_ends - other).any():
        return False
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((a[at + np.repeat(starts, n)] == b[at + np.repeat(other, n)]).all())


class Encoder:
    """Encodes pieces of text, keeping the ids of pieces it has met. One lives in each worker."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        # of tokens that begin at one place the longest is taken
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(added, key=len, reverse=True))) if added else None
        self.forget()

    @classmethod
    def of(cls, path: str, special: bool = False) -> Encoder:
        if (path, special) not in cls._made:
            cls._made[path, special] = cls(path, special)
        return cls._made[path, special]

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # names in order with their slots: those known long, and those learned lately
        self.levels = [none, none]
        self.first, self.ids, self.slots, self.filled = np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0
        self.spelled, self.letters, self.written = np.zeros(1024, np.int64), np.zeros(4096, np.uint8), 0

    def rest(self) -> None:
        """Between tasks of a worker: few pieces stay for the next task, many would count against its executor."""
        if self.slots > KEEP_PIECES:
            self.forget()

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Slots of names; -1 for those not known."""
        out = np.full(len(names), -1)
        for known, slot in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, names), len(known) - 1)
                hit = known[at] == names
                out[hit] = slot[at[hit]]
        return out

    def _learn(self, names: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Encode pieces with these (sorted) names; their slots."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        fresh = self.slots + np.arange(len(names))
        while len(self.first) <= self.slots + len(names):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.spelled = np.concatenate([self.spelled, np.zeros_like(self.spelled)])
        letters = np.frombuffer(b"".join(raw), np.uint8)
        while len(self.letters) < self.written + len(letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[self.written : self.written + len(letters)] = letters
        self.spelled[fresh + 1] = self.written + np.cumsum([len(r) for r in raw])
        self.written += len(letters)
        while len(self.ids) < self.filled + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.first[fresh + 1] = self.filled + np.cumsum(sizes)
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.slots, self.filled = self.slots + len(names), self.filled + len(flat)
        known, slot = self.levels[1]
        at = np.searchsorted(known, names)
        self.levels[1] = np.insert(known, at, names), np.insert(slot, at, fresh)
        if len(self.levels[1][0]) > LATELY:
            (a, x), (b, y) = self.levels
            at = np.searchsorted(a, b)
            self.levels = [(np.insert(a, at, b), np.insert(x, at, y)), (a[:0], x[:0])]
        return fresh

    def _added_places(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, end) of each added token in the texts."""
        if self.added is None or not self.added.search(raw := data.tobytes()):
            return
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for m in self.added.finditer(raw, a, b):
                yield m.span()

    def _plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of a piece, one after another, and their numbers of ids."""
        data, offsets = piece.data, piece.offsets
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[:-2] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
            cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
            last = offsets[1:-1] - 1
            last = last[(last >= 0) & (data[last] == 0x20)]
            cut[last] = False  # what follows a text's last space is another text
        before = 0  # end of the added token before
        for s, e in self._added_places(data, offsets):
            if s - 1 > before and data[s - 1] == 0x20:
                cut[s - 1] = False  # a space before an added token ends the text between
            cut[s + 1 : e] = False
            cut[[s, e]] = True
            before = e
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        name = range_hash(BYTE_CODES[data], starts, ends)
        unique, first, back = np.unique(name, return_index=True, return_inverse=True)
        if not _same_bytes(data, starts, ends, data, starts[first][back], ends[first][back]):
            return self._plainly(data, offsets)
        if self.slots > CACHE_PIECES:
            self.forget()
        found = self._find(unique)
        old = found >= 0
        if not _same_bytes(data, starts[first][old], ends[first][old], self.letters, self.spelled[found[old]], self.spelled[found[old] + 1]):
            return self._plainly(data, offsets)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn(unique[new], [data[starts[i] : ends[i]].tobytes() for i in first[new]])
        slot = found[back]
        lo, n = self.first[slot], self.first[slot + 1] - self.first[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(int(total[-1])) - np.repeat(total[:-1], n) + np.repeat(lo, n)]
        counts = np.diff(total[np.searchsorted(starts, offsets)])
        return ids, counts


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, mode: str = "byte", text: str = "text", special: bool = False) -> None:
    """Write the token files of docs to a folder that all executors share."""
    if mode not in ("byte", "bit"):
        raise ValueError(f"unknown mode {mode!r}")

    def chunk(part: int, number: int, start: int, docs_: list, ids: list[np.ndarray], lengths: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(ids)
        payload, ends = encode_chunk(flat, mode)
        longs = pa.list_(pa.int64())
        cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([mode]), pa.array([docs_], longs), pa.array([lengths], longs), pa.array([ends], longs), pa.array([payload], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer, special), TaskContext.get().partitionId()
        number = start = held = 0
        docs_: list = []
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for piece in pieces(batch.column("text"), PIECE):
                got, counts = encoder.encode(piece)
                ends = np.cumsum(counts)
                flat = np.insert(got, ends, END_ID)
                ids.append(flat.astype(np.uint32))
                lengths += (counts + 1).tolist()
                docs_ += [names[i] for i in piece.rows]
                held += len(flat)
                if held >= CHUNK_IDS:
                    yield chunk(part, number, start, docs_, ids, lengths)
                    number, start, held, docs_, ids, lengths = number + 1, start + held, 0, [], [], []
        if held:
            yield chunk(part, number, start, docs_, ids, lengths)
        encoder.rest()  # a worker lives on after its task

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("print"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = read.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "print").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "print")
    map_batches(ordered.select("doc_id", "text"), run, CHUNKS).write.option("compression", "uncompressed").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, part, place, start, n_tokens and the crc32 of its ids, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("part", "start", "n_ids", "mode", "docs", "lengths", "ends", "payload")}
                ids = decode_chunk(row["payload"].as_py(), row["ends"].as_py(), row["n_ids"].as_py(), row["mode"].as_py())
                n = np.array(row["lengths"].as_py(), np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"].as_py(), pa.int64()), pa.array([row["part"].as_py()] * len(n), pa.int32()), pa.array(ends - n + row["start"].as_py()), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "within", "n_tokens", "ids_crc32"])

    chunks = spark.read.schema(CHUNKS).parquet(folder)
    docs = map_batches(chunks, run, "doc_id long, part int, within long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row a part: as many as spark.sql.shuffle.partitions was when the files were written
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens_of(docs: DataFrame, tokenizer: str | None = None, mode: str = "byte", special: bool = False) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_tokens(docs, folder, tokenizer or tokenizer_path(), mode, special=special)
    return read_tokens(spark, folder)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' token files and returns what they hold, a row for each document: null
    and repeated ids, null texts and empty tables as the module says."""
    return tokens_of(docs, special=True)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over documents; nulls, ties and empty tables as the module says."""
    return tokens_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), special=True)
