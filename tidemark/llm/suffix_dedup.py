"""Removal of repeated byte strings by bucket-pointer refinement over a sampled suffix array.

A byte is removed when a string of LENGTH bytes that covers it also starts in a document with a
smaller id. The steps:

1. Sampling. In each string of LENGTH bytes the q-gram with the least hash is an anchor (the
   leftmost of equals). Equal strings choose the same anchor at the same offset, so every repeat
   shows as two anchors with one q-gram; about one position in sixteen is an anchor.
2. Initial buckets. Anchors are grouped by q-gram over the whole corpus; a bucket in which only
   one document occurs is finished.
3. Refinement. Anchors of the other buckets bring the bytes around them. Every STEP bytes of
   these surroundings is a suffix with a pointer to its bucket of STEP bytes. From the last offset
   to the first, the buckets of the suffixes at one offset are refined by sorting on the bucket
   pointers STEP bytes later, and write the pointers that the next round sorts on; the q-gram's
   own bucket is refined last, by the pointers at offset 0. Buckets of one member are left out.
   This is done to the right of the q-gram and, mirrored, to the left. The common prefix lengths
   of neighbours then give the bucket of an anchor at every depth.
4. For each offset of a string around the anchor, the buckets to its left and right name the
   string; where the smallest document of that name is smaller, the string is marked, and marks
   go back to the documents.

A bucket is named by the 64-bit hash of its q-gram; the other bytes of a string are compared as
they are. Hot buckets: a task that sees a q-gram in several documents knows by itself that the
bucket lives, so it sends two of these documents to the bucket and the others straight on; and
equal surroundings are reduced to the smallest document within a task before the shuffle. A
document is addressed by its part, id and a number among the texts of one id.

Nulls: a null text is empty; a null doc_id counts as the smallest id. Rows with equal ids are
not smaller than each other. Texts shorter than LENGTH lose nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.packed import doc_salt, group_starts, grouped, hash_part, meet, n_parts, pack, rows_of, split_by, spread, text_bytes, unpack, with_doc_part
from tidemark.llm.textkit import BYTE_CODES, Piece, covered, doc_keys, map_batches, pieces, range_hash, row_names

LENGTH = 50
GRAM = 20
SIDE = LENGTH - GRAM
STEP = 8
TASK_ANCHORS = 800_000
GROUP_ANCHORS = 60_000
RANGE_ANCHORS = 60_000
U64 = np.uint64

_BUCKETS = "part int, grams binary, docs binary, homes binary, own_grams binary, own_docs binary, own_homes binary"
_LIVE = "part int, grams binary, docs binary"
_AROUND = "part int, grams binary, docs binary, homes binary, variants binary, places binary, lefts binary, rights binary, left_bytes binary, right_bytes binary, local_docs binary, local_homes binary, local_variants binary, local_places binary, local_marks binary"
_MARKS = "part int, docs binary, variants binary, places binary, marks binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _anchors(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, q-gram hashes and rows (in the piece) of the anchors."""
    n = len(piece.data)
    sizes = np.diff(piece.offsets)
    room = np.maximum(sizes - LENGTH + 1, 0)
    if not room.any():
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    at = np.arange(n - GRAM + 1)
    gram = range_hash(BYTE_CODES[piece.data], at, at + GRAM)
    low = (gram & U64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while 2 * span <= SIDE + 1:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = SIDE + 1 - span
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    chosen = np.zeros(n, bool)
    inside = np.zeros(n + 1, np.int64)
    some = room > 0
    np.add.at(inside, piece.offsets[:-1][some], 1)
    np.add.at(inside, piece.offsets[:-1][some] + room[some], -1)
    valid = np.flatnonzero(np.cumsum(inside[:n])[: len(low)] > 0)
    chosen[(low[valid] & U64(0xFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, gram[at], np.searchsorted(piece.offsets, at, "right") - 1


def _bucket_rows(gram: np.ndarray, doc: np.ndarray, home: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((home, doc, gram))
    order = order[group_starts(gram[order], doc[order], home[order])]
    gram, doc, home = gram[order], doc[order], home[order]
    starts = group_starts(gram)
    ends = np.append(starts[1:], len(gram)) - 1
    lives = spread(doc[starts] != doc[ends], starts, len(gram))
    # the smallest and the largest document of a q-gram, and all rows of one that is not known to live
    sent = ~lives
    sent[starts] = sent[ends] = True
    sent, own = np.flatnonzero(sent), np.flatnonzero(~sent)
    schema = _arrow(_BUCKETS)
    out: dict[str, list] = {f.name: [] for f in schema}
    split = list(split_by(hash_part(gram[sent], parts)))
    for (p, rows), o in zip(split, np.array_split(own, len(split)), strict=True):  # those that live travel in even shares
        rows = sent[rows]
        values = [p, pack(gram[rows], True), pack(doc[rows]), pack(home[rows]), pack(gram[o], True), pack(doc[o]), pack(home[o])]
        for key, value in zip(schema.names, values, strict=True):
            out[key].append(value)
    yield from rows_of(out, schema).to_batches()


def initial_buckets(docs: DataFrame, parts: int) -> DataFrame:
    """Packed (q-gram, document) pairs of every anchor, a q-gram and document once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            doc, home = doc_keys(batch, "doc"), batch.column("part").to_numpy()
            for piece in pieces(batch.column("text")):
                _, gram, row = _anchors(piece)
                found.append([gram, doc[piece.rows[row]], home[piece.rows[row]]])
                held += len(gram)
                if held > TASK_ANCHORS:
                    yield from _bucket_rows(*(np.concatenate(x) for x in zip(*found, strict=True)), parts)
                    found, held = [], 0
        if held:
            yield from _bucket_rows(*(np.concatenate(x) for x in zip(*found, strict=True)), parts)

    return map_batches(docs.select("doc", "part", "text"), run, _BUCKETS)


def live_buckets(buckets: DataFrame, parts: int) -> DataFrame:
    """Of buckets in which two documents occur, the (q-gram, document) pairs, by document part."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c, kind, delta=False: np.concatenate([unpack(x, kind, delta) for x in table[c].to_pylist()])
        gram, doc, home = col("grams", np.uint64, True), col("docs", np.int64), col("homes", np.int32)
        order = np.argsort(gram, kind="stable")
        gram, doc, home = gram[order], doc[order], home[order]
        starts = group_starts(gram)
        live = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        keep = spread(live, starts, len(gram))
        gram, doc, home = (np.concatenate([a[keep], b]) for a, b in ((gram, col("own_grams", np.uint64, True)), (doc, col("own_docs", np.int64)), (home, col("own_homes", np.int32))))
        order = np.argsort(gram, kind="stable")
        gram, doc, home = gram[order], doc[order], home[order]
        out: dict[str, list] = {"part": [], "grams": [], "docs": []}
        for p, rows in split_by(home):
            out["part"].append(p)
            out["grams"].append(pack(gram[rows], True))
            out["docs"].append(pack(doc[rows]))
        return rows_of(out, _arrow(_LIVE))

    return grouped(buckets, run, _LIVE)


def _variants(table: pa.Table) -> np.ndarray:
    """A number for each text among the rows of a part that share an id."""
    doc = table["doc"].to_numpy()
    if len(np.unique(doc)) == len(doc):
        return np.zeros(len(doc), np.int64)
    prints = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in table["text"].to_pylist()]
    known: dict[int, dict[bytes, int]] = {}
    for d, h in sorted(zip(doc.tolist(), prints, strict=True)):
        known.setdefault(d, {}).setdefault(h, len(known[d]))
    return np.array([known[d][h] for d, h in zip(doc.tolist(), prints, strict=True)], np.int64)


def _side_bytes(data: np.ndarray, at: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """SIDE bytes from `at` on, in direction `step`; zero beyond `room`."""
    j = np.arange(SIDE)
    where = at[:, None] + step * j[None, :]
    out = data[np.clip(where, 0, len(data) - 1)]
    out[j[None, :] >= room[:, None]] = 0
    return out


def _room(behind: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """For every anchor, bit o: a string that starts o bytes before it lies in the document."""
    marks = np.zeros(len(behind), np.uint32)
    for o in range(SIDE + 1):
        marks |= ((behind >= o) & (ahead >= SIDE - o)).astype(np.uint32) << np.uint32(o)
    return marks


def surroundings(docs: DataFrame, live: DataFrame, parts: int) -> DataFrame:
    """Anchors of live buckets with the bytes around them, by q-gram part.

    Equal surroundings within a task keep the smallest document; the others are marked here.
    """

    schema = _arrow(_AROUND)

    def rows(home: int, found: list[list[np.ndarray]]) -> pa.Table:
        gram, doc, variant, place, behind, ahead, lb, rb = (np.concatenate(x) for x in zip(*found, strict=True))
        homes = np.full(len(gram), home, np.int32)
        name = row_names(np.concatenate([lb, rb, behind[:, None].astype(np.uint8), ahead[:, None].astype(np.uint8)], 1))
        order = np.lexsort((doc, name, gram))
        starts = group_starts(gram[order], name[order])
        least = np.empty(len(doc), np.int64)
        least[order] = spread(doc[order][starts], starts, len(doc))
        marks = _room(behind, ahead)
        gone = np.flatnonzero((doc != least) & (marks > 0))
        keep = np.flatnonzero(doc == least)
        keep = keep[np.argsort(gram[keep], kind="stable")]
        out: dict[str, list] = {f.name: [] for f in schema}
        split = list(split_by(hash_part(gram[keep], parts)))
        for (p, r), g in zip(split, np.array_split(gone, len(split)), strict=True):  # marks travel in even shares
            r = keep[r]
            own = [p, pack(gram[r], True), pack(doc[r]), pack(homes[r]), pack(variant[r].astype(np.int32)), pack(place[r]), pack(behind[r].astype(np.uint8)), pack(ahead[r].astype(np.uint8)), pack(lb[r]), pack(rb[r])]
            local = [pack(doc[g]), pack(homes[g]), pack(variant[g].astype(np.int32)), pack(place[g]), pack(marks[g])]
            for key, value in zip(schema.names, own + local, strict=True):
                out[key].append(value)
        return rows_of(out, schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        variant, home = _variants(left), left["part"][0].as_py()
        doc = left["doc"].to_numpy()
        grams = np.concatenate([unpack(x.as_py(), np.uint64, True) for x in right["grams"]])
        owners = np.concatenate([unpack(x.as_py(), np.int64) for x in right["docs"]])
        wanted = np.unique(grams ^ doc_salt(owners))
        owned = np.isin(doc, owners)
        tables, found, held = [], [], 0
        texts = left["text"].filter(pa.array(owned))
        doc, variant = doc[owned], variant[owned]
        base = 0
        for chunk in texts.chunks:
            for piece in pieces(chunk):
                at, gram, row = _anchors(piece)
                d = doc[piece.rows[row] + base]
                key = gram ^ doc_salt(d)
                hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                at, gram, row, d = at[hit], gram[hit], row[hit], d[hit]
                place = at - piece.offsets[row]
                ahead = np.minimum(piece.offsets[row + 1] - at - GRAM, SIDE)
                behind = np.minimum(place, SIDE)
                if len(at):
                    found.append([gram, d, variant[piece.rows[row] + base], place, behind, ahead, _side_bytes(piece.data, at - 1, behind, -1), _side_bytes(piece.data, at + GRAM, ahead, 1)])
                held += len(at)
                if held > GROUP_ANCHORS:
                    tables.append(rows(home, found))
                    found, held = [], 0
            base += len(chunk)
        if held:
            tables.append(rows(home, found))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return meet(docs, live, run, _AROUND)


def refine(pointer: np.ndarray, later: np.ndarray) -> np.ndarray:
    """One round: within each bucket of two or more, sort on the bucket pointers at a later offset
    and write new pointers.

    A pointer is the place of its bucket's first member in the sorted order.
    """
    active = np.flatnonzero(np.bincount(pointer)[pointer] > 1) if len(pointer) else pointer
    if not len(active):
        return pointer
    old, key = pointer[active], later[active]
    order = np.lexsort((key, old))
    old, key = old[order], key[order]
    bucket = group_starts(old)
    part = group_starts(old, key)
    out = pointer.copy()
    inside = np.arange(len(active)) - spread(bucket, bucket, len(active))
    out[active[order]] = old + spread(inside[part], part, len(active))
    return out


def bucket_pointers(sides: np.ndarray) -> np.ndarray:
    """For the suffixes at each STEP bytes of the rows, the first place of their bucket of STEP bytes
    in the sorted order of all these suffixes; what is beyond the row counts as zero."""
    wide = np.zeros((len(sides), -(-SIDE // STEP) * STEP), np.uint8)
    wide[:, :SIDE] = sides
    grams = np.ascontiguousarray(wide).view(">u8").astype(np.uint64)
    flat = grams.ravel()
    order = np.argsort(flat, kind="stable")
    starts = group_starts(flat[order])
    out = np.empty(len(flat), np.int64)
    out[order] = spread(starts, starts, len(flat))
    return out.reshape(grams.shape)


def depth_names(bucket: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the suffixes `sides` within buckets, places, and common prefix lengths."""
    n = len(bucket)
    pointers = bucket_pointers(sides)
    for offset in range(pointers.shape[1] - 2, -1, -1):  # later offsets first: their new pointers are sorted on
        pointers[:, offset] = refine(pointers[:, offset], pointers[:, offset + 1])
    pointer = refine(bucket, pointers[:, 0])
    order = np.argsort(pointer, kind="stable")
    same = sides[order[1:]] == sides[order[:-1]]
    lcp = np.where(same.all(1), SIDE, same.argmin(1))
    lcp[bucket[order[1:]] != bucket[order[:-1]]] = -1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, np.concatenate([[-1], lcp])


def _mark(gram, doc, behind, ahead, lb, rb) -> np.ndarray:
    """For every anchor, bit o: the string that starts o bytes before it is in a smaller document."""
    marks = np.zeros(len(gram), np.uint32)
    order = np.argsort(gram, kind="stable")
    starts = group_starts(gram[order])
    bucket = np.empty(len(gram), np.int64)
    bucket[order] = spread(starts, starts, len(gram))
    _, r_place, r_lcp = depth_names(bucket, rb)
    _, l_place, l_lcp = depth_names(bucket, lb)
    for o in range(SIDE + 1):
        valid = np.flatnonzero((behind >= o) & (ahead >= SIDE - o))
        if len(valid) < 2:
            continue
        right = np.cumsum(r_lcp < SIDE - o)[r_place[valid]]
        left = np.cumsum(l_lcp < o)[l_place[valid]]
        name = left * np.int64(len(gram) + 1) + right
        by = np.argsort(name, kind="stable")
        starts = group_starts(name[by])
        least = spread(np.minimum.reduceat(doc[valid][by], starts), starts, len(by))
        late = valid[by[doc[valid][by] > least]]
        marks[late] |= np.uint32(1 << o)
    return marks


def _marks_of(gram, doc, behind, ahead, lb, rb) -> np.ndarray:
    """_mark() for anchors among which surroundings repeat: only one of equals, of the smallest
    document, goes into the refinement; those of larger documents are marked wherever they can be."""
    name = row_names(np.concatenate([lb, rb, behind[:, None].astype(np.uint8), ahead[:, None].astype(np.uint8)], 1))
    order = np.lexsort((doc, name, gram))
    starts = group_starts(gram[order], name[order])
    lead = order[starts]
    marks, least = np.empty(len(gram), np.uint32), np.empty(len(gram), np.int64)
    marks[order] = spread(_mark(gram[lead], doc[lead], behind[lead], ahead[lead], lb[lead], rb[lead]), starts, len(gram))
    least[order] = spread(doc[lead], starts, len(gram))
    return np.where(doc > least, _room(behind, ahead), marks)


def marked_strings(around: DataFrame, parts: int) -> DataFrame:
    """Refine the buckets of a part and send marks to the parts of their documents."""

    schema = _arrow(_MARKS)

    def send(doc, home, variant, place, marks) -> pa.Table:
        hit = np.flatnonzero(marks)
        hit = hit[np.lexsort((place[hit], doc[hit]))]
        out: dict[str, list] = {f.name: [] for f in schema}
        for p, rows in split_by(home[hit]):
            r = hit[rows]
            for key, value in zip(schema.names, [p, pack(doc[r], True), pack(variant[r]), pack(place[r]), pack(marks[r])], strict=True):
                out[key].append(value)
        return rows_of(out, schema)

    def run(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.concatenate([unpack(x.as_py(), kind) for x in table[name]])
        tables = [send(column("local_docs", np.int64), column("local_homes", np.int32), column("local_variants", np.int32), column("local_places", np.int64), column("local_marks", np.uint32))]
        # one range of q-grams after another, so that memory follows the range and not the part
        grams = [unpack(x.as_py(), np.uint64, True) for x in table["grams"]]
        every = np.sort(np.concatenate(grams))
        ranges = -(-len(every) // RANGE_ANCHORS)
        cuts = np.unique(every[np.arange(ranges) * len(every) // ranges])
        del every
        starts = [np.append(np.searchsorted(g, cuts), len(g)) for g in grams]
        for k in range(len(cuts)):
            gram = np.concatenate([g[s[k] : s[k + 1]] for g, s in zip(grams, starts, strict=True)])
            col = lambda name, kind, width=1: np.concatenate([unpack(x.as_py(), kind, width=width)[s[k] : s[k + 1]] for x, s in zip(table[name], starts, strict=True)])
            doc, behind, ahead = col("docs", np.int64), col("lefts", np.uint8).astype(np.int64), col("rights", np.uint8).astype(np.int64)
            lb, rb = col("left_bytes", np.uint8, SIDE), col("right_bytes", np.uint8, SIDE)
            tables.append(send(doc, col("homes", np.int32), col("variants", np.int32), col("places", np.int64), _marks_of(gram, doc, behind, ahead, lb, rb)))
        return pa.concat_tables(tables)

    return grouped(around, run, _MARKS)


def removed_bytes(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Per document: sizes, removed runs, what is left and its digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        variant = _variants(left)
        doc = left["doc"].to_numpy()
        col = lambda name, kind, delta=False: np.concatenate([np.zeros(0, kind), *(unpack(x, kind, delta) for x in right[name].to_pylist())])
        who, which, place, mark = col("docs", np.int64, True), col("variants", np.int32), col("places", np.int64), col("marks", np.uint32)
        order = np.lexsort((which, who))
        who, which, place, mark = who[order], which[order], place[order], mark[order]
        texts = left["text"].combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        out: dict[str, list] = {f.name: [] for f in schema}
        for piece in pieces(texts):
            for i, row in enumerate(piece.rows):
                data = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                lo, hi = np.searchsorted(who, [doc[row], doc[row] + 1])
                mine = slice(lo, hi)
                if hi > lo and which[hi - 1] != which[lo]:
                    a, b = np.searchsorted(which[mine], [variant[row], variant[row] + 1])
                    mine = slice(lo + a, lo + b)
                elif hi > lo and which[lo] != variant[row]:
                    mine = slice(lo, lo)
                n, spans = 0, 0
                if mine.stop > mine.start:
                    bits = (mark[mine][:, None] >> np.arange(SIDE + 1, dtype=np.uint32)[None, :]) & 1
                    a, o = np.nonzero(bits)
                    gone = covered(place[mine][a] - o, LENGTH, len(data))
                    n = int(gone.sum())
                    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                    data = data[~gone]
                out["n_bytes"].append(len(data) + n)
                out["n_removed"].append(n)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(data.tobytes()).hexdigest())
        out["doc_id"] = left["doc_id"].to_pylist()
        return rows_of(out, schema)

    return meet(docs, marks, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, text: str = "text") -> DataFrame:
    parts = n_parts(text_bytes(docs, text))
    rows = with_doc_part(docs, parts, text)
    by_part = rows.select("part", "doc", "doc_id", "text")
    live = live_buckets(initial_buckets(rows, parts), parts)
    return removed_bytes(by_part, marked_strings(surroundings(by_part, live, parts), parts))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over documents; nulls, ties and empty tables as the module says."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
