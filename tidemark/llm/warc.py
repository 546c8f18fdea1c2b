"""WARC archives in seekable Zstandard bundles, and reading them back by record.

A bundle is one file in the seekable format of Zstandard: independent frames, each of some whole
WARC records (about FRAME_BYTES; a longer record has a frame to itself), then a skippable frame that
holds the seek table (compressed and decompressed size of each frame) and a footer with the number
of frames and a magic number. Any Zstandard tool reads the whole; a reader that wants one record
takes the seek table from the end, decompresses one frame and cuts the record out of it.

The index maps each record to (bundle, frame, offset in the decompressed frame, length).

Bundles and index are tables of one folder, a bundle a row with its bytes, so any store that Spark
reads will do and a task that is run again replaces what it wrote; `export` puts the bundles as
`.warc.zst` files into a folder that tasks can write to.

Copies. Payloads of LEAST_BYTES or more are compared by SHA-256: the record with the smallest id
(a null id is the largest) is the response, all others are revisits of it without a payload of their
own, which name it, its digest and the payload's length. Rows equal in id and payload are one page:
if it is the response, all of them are. Smaller payloads are responses always.

Nulls: a null payload is empty; a null id is written as `null` and is never read as a number; a null
url gives no target header; white space and controls in a url are percent-encoded. Further columns
are not read, whatever their names. Empty tables give empty archives.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.joins import join_side
from tidemark.llm.textkit import map_batches
from tidemark.session import scratch

LEAST_BYTES = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20

# fixed values of the seekable format
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

BUNDLES = "bundle string, content binary"
INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, target string, payload binary"


# ---- bundles


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle, of (compressed, decompressed) sizes of its frames."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    width = 12 if flags & 0x80 else 8  # with checksums, which we don't write
    head = len(bundle) - 9 - n * width - 8
    if magic != SEEKABLE or head < 0 or struct.unpack("<II", bundle[head : head + 8]) != (SKIPPABLE, n * width + 9):
        raise ValueError("no seek table at the end")
    out, at = [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", bundle, head + 8 + i * width)
        out.append((at, packed, size))
        at += packed
    if at != head:
        raise ValueError("frames do not fill the bundle")
    return out


def read_frame(bundle: bytes | memoryview, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    out = zstandard.ZstdDecompressor().decompress(memoryview(bundle)[start : start + packed], max_output_size=size)
    if len(out) != size:
        raise ValueError("a frame is not as long as the seek table says")
    return out


class Bundler:
    """Gathers records into frames and frames into bundles; `add` and `close` return full bundles."""

    def __init__(self, name: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.name, self.frame_bytes, self.bundle_bytes = name, frame_bytes, bundle_bytes
        self.press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.number = -1
        self._open()

    def _open(self) -> None:
        self.number += 1
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, str, int, int, int]] = []
        self.frame: list[bytes] = []
        self.held = self.written = 0

    @property
    def bundle(self) -> str:
        return f"{self.name}-{self.number:05d}"

    def _end_frame(self) -> None:
        if self.frame:
            packed = self.press.compress(b"".join(self.frame))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.held))
            self.written += len(packed)
            self.frame, self.held = [], 0

    def _end_bundle(self) -> list[tuple[str, bytes, list]]:
        self._end_frame()
        if not self.frames:
            return []
        out = [(self.bundle, b"".join(self.frames) + seek_table(self.sizes), self.index)]
        self._open()
        return out

    def add(self, record_id: str, record: bytes) -> list[tuple[str, bytes, list]]:
        if self.frame and self.held + len(record) > self.frame_bytes:
            self._end_frame()
        full = self._end_bundle() if self.written >= self.bundle_bytes else []
        self.index.append((record_id, self.bundle, len(self.sizes), self.held, len(record)))
        self.frame.append(record)
        self.held += len(record)
        return full

    def close(self) -> list[tuple[str, bytes, list]]:
        return self._end_bundle()


# ---- records


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def make_record(record_id: str, target: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no block but keeps the payload's digest and length."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if target is not None:
        head.append(f"WARC-Target-URI: {_clean(target)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _named(value: str) -> str:
    return value.removeprefix("<urn:page:").removesuffix(">")


def parse_record(data: bytes) -> tuple:
    """RECORDS of one record; a response's length and digest are those of the block that is there."""
    at = data.index(b"\r\n\r\n")
    version, *lines = data[:at].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines)
    n = int(head["Content-Length"])
    block = data[at + 4 : at + 4 + n]
    if version != "WARC/1.1" or len(block) != n or data[at + 4 + n :] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        digest, size = hashlib.sha256(block).hexdigest(), n
        if digest != stated:
            raise ValueError(f"record {head['WARC-Record-ID']}: the payload is not that of its digest")
    else:
        digest, size = stated, int(head["X-Payload-Length"])
    refers = _named(head["WARC-Refers-To"]) if kind == "revisit" else None
    return _named(head["WARC-Record-ID"]), kind, size, digest, refers, head.get("WARC-Target-URI"), block if kind == "response" else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.large_binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [f for f, _ in fields])


# ---- tables


def with_first_copies(pages: DataFrame, record: Column, target: Column, payload: Column, least: int = LEAST_BYTES) -> DataFrame:
    """record, target, payload, digest, and refers_to: the response's id where this is a revisit.

    Digests are summed up before the shuffle, so a payload with a third of all rows is some rows of
    counts; only digests that occur with two ids or more come back, by a salted join where they are many.
    """
    body = F.coalesce(payload, F.lit(""))
    rows = pages.select(record.cast("long").alias("record"), target.cast("string").alias("target"), body.cast("binary").alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    none = F.lit((1 << 63) - 1)
    held = pages.select(record.cast("long").alias("record"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    ids = F.coalesce(F.col("record"), none)
    spark = pages.sparkSession
    folder = scratch(spark, "copies")
    held.groupBy("digest").agg(F.min("record").alias("first"), F.min(ids).alias("low"), F.max(ids).alias("high")).where(F.col("low") < F.col("high")).select("digest", "first").write.parquet(folder)
    joined = join_side(rows, spark.read.parquet(folder), "digest", F.coalesce(F.col("record"), F.xxhash64("target")))
    later = F.col("first").isNotNull() & (F.col("record").isNull() | (F.col("record") > F.col("first"))) & (F.col("size") >= least)
    return joined.select("record", "target", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write_archive(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write bundles and index of with_first_copies() to a shared folder; no row moves for it."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(f"part-{TaskContext.get().partitionId():06d}", frame_bytes, bundle_bytes)

        def out(full: list[tuple[str, bytes, list]]) -> Iterator[pa.RecordBatch]:
            for name, content, index in full:
                entries = pa.array([[dict(zip(("record_id", "frame", "offset", "length"), (r, f, o, n), strict=True)) for r, _, f, o, n in index]], pa.list_(entry))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), entries], ["bundle", "content", "entries"])

        for batch in batches:
            for i in range(batch.num_rows):
                record, target, payload, digest, refers = (batch.column(c)[i].as_py() for c in ("record", "target", "payload", "digest", "refers_to"))
                name = "null" if record is None else str(record)
                yield from out(bundler.add(name, make_record(name, target, payload, digest, None if refers is None else str(refers))))
        yield from out(bundler.close())

    entry = pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    schema = BUNDLES + ", entries array<struct<record_id: string, frame: int, offset: bigint, length: bigint>>"
    map_batches(rows, bundles, schema).write.option("compression", "uncompressed").option("parquet.block.size", 2 * bundle_bytes).parquet(f"{folder}/bundles")


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """INDEX of an archive; the bundles' bytes are not read for it."""
    return spark.read.parquet(f"{folder}/bundles").select("bundle", F.explode("entries").alias("e")).select("e.record_id", "bundle", "e.frame", "e.offset", "e.length")


def records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of an archive: each frame that the seek table names is decompressed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bundle = memoryview(batch.column("content")[i].as_buffer())
                table, frames = read_seek_table(bundle), {}
                for e in batch.column("entries")[i].as_py():
                    frames.setdefault(e["frame"], []).append((e["offset"], e["length"]))
                for number in sorted(frames):
                    data = read_frame(bundle, table[number])
                    rows = [parse_record(data[o : o + n]) for o, n in frames[number]]
                    yield _batch(rows if payloads else [(*r[:-1], None) for r in rows], RECORDS)

    return map_batches(spark.read.parquet(f"{folder}/bundles").select("content", "entries"), run, RECORDS)


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in `wanted`: only their frames are decompressed."""
    found = index_of(spark, folder).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    places = found.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))  # of one bundle: bounded by its size
    bundles = spark.read.parquet(f"{folder}/bundles").select("bundle", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bundle = memoryview(batch.column("content")[i].as_buffer())
                table, frames = read_seek_table(bundle), {}
                for p in batch.column("places")[i].as_py():
                    if p["frame"] not in frames:
                        frames[p["frame"]] = read_frame(bundle, table[p["frame"]])
                    yield _batch([parse_record(frames[p["frame"]][p["offset"] : p["offset"] + p["length"]])], RECORDS)

    return map_batches(bundles.join(places, "bundle").select("content", "places"), run, RECORDS)


def export(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Write the bundles as files to a folder that all tasks can write to; returns (bundle, path, size).
    A file is written aside and moved into place, so a task that runs twice leaves one whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(target, exist_ok=True)
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column("bundle")[i].as_py(), batch.column("content")[i].as_py()
                path = os.path.join(target, f"{name}.warc.zst")
                aside = f"{path}.{uuid.uuid4().hex}"
                with open(aside, "wb") as f:
                    f.write(content)
                os.replace(aside, path)
                yield _batch([(name, path, len(content))], "bundle string, path string, size long")

    return map_batches(spark.read.parquet(f"{folder}/bundles").select("bundle", "content"), run, "bundle string, path string, size long")


def plain(bundle: bytes) -> bytes:
    """A whole bundle decompressed as any Zstandard tool does, the seek table being skipped."""
    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle), read_across_frames=True).read()


def archive(pages: DataFrame, folder: str, record: str = "page_id", target: str = "url", payload: str = "html") -> None:
    write_archive(with_first_copies(pages, pages[record], pages[target], pages[payload]), folder)


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over pages: written as an archive, read back from its bundles; nulls, ties and empty tables
    as the module says (a null page_id is read back as null)."""
    folder = scratch(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    number = F.col("record_id").try_cast("long")
    return records(spark, folder, payloads=False).select(number.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))
