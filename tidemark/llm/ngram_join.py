"""Join of documents on the Jaccard similarity of their word n-grams.

Documents with one set of n-grams form a class; links are sought between classes.

1. N-grams are ordered rare first: by a count from a sketch over all documents whose cells grow with the
   corpus up to 2 ** CELL_BITS[1] (a count may be too high, never too low), then by hash. Any order that all share is right; this
   one puts passages that many documents share at the end.
2. Prefix filter: two linked sets share an n-gram among the first n - ceil(t n) + 1 of each.
3. Length and positional filters drop pairs that cannot reach the overlap. Postings of an n-gram
   with up to SMALL_BUCKET classes give all pairs that pass. Longer ones give the pairs with one
   leader each; a task that has over TASK_LIST members of a list pairs them with a leader of its own
   and sends on the leader only, so no task gets a list whole. After these pairs are verified and joined
   to components, lists that hold several components still are dealt into blocks, anew in each of up to
   LEADER_ROUNDS rounds, and every member gets a leader there: the first one of another component that passes
   the filter below. That is a pair a member; rounds end when one adds no link. Then lists give all pairs
   whose members are in different components even so, so no link between components is lost. A round
   reads the corpus once for the sets of what it pairs. Only classes of near sizes meet for these (a list is cut into
   bands of sizes, and these into blocks), and pairs pass a filter of whole sets first: each n-gram flips
   one bit of its set's parity bitmap, two bitmaps differ in no more bits than the sets in n-grams, and
   linked sets differ in few. A bitmap has a bit or two for each n-gram of its set; of two lengths, powers of
   two, the longer one is folded by exclusive or, which gives the bitmap of the shorter length.
4. Each pair is verified once on the whole sets, behind a suffix filter: fixed pivots cut both sets, and what
   they have in each range bounds the intersection.

Linked components follow from verified pairs by alternating stars.

Nulls: a null or wordless text has an empty set and no link; its component is its own id. A null
doc_id gets the smallest id of its class or component that is not null. Repeated rows share a
class. Extra columns are not read. A class is named by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components, joined
from tidemark.llm.joins import hash_filter, passes
from tidemark.llm.packed import group_starts, grouped, hash_part, n_parts, pack, rows_of, split_by, spread, text_bytes, unpack
from tidemark.llm.suffix_dedup import _arrow
from tidemark.llm.textkit import LOWER, Words, map_batches, mix, pieces, range_hash, windows
from tidemark.session import cut, scratch

GRAM = 4
PERCENT = 85
STAGE_GRAM = 5
STAGE_PERCENT = 80
CELL_BITS = (20, 22)
CELL_BYTES = 512
SLICES = 32
SMALL_BUCKET = 12
TASK_LIST = 100
TASK_POSTINGS = 500_000
MAX_RANK = 255
FILTER_BITS = 23
PIVOTS = 16
LEAST_PARITY, MOST_PARITY = 1 << 10, 1 << 14
LIST_BLOCK = 1024
LEADER_ROUNDS = 1
U64 = np.uint64

_POSTINGS = "part int, grams binary, classes binary, sizes binary, places binary, leads binary, own_pairs binary, own_grams binary, own_classes binary, own_sizes binary, own_places binary"


class Shape:
    """What counts as an n-gram, and when two sets are linked."""

    def __init__(self, gram: int = GRAM, percent: int = PERCENT):
        self.gram, self.percent = gram, percent

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def gram_sets(piece, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document (sorted by document), and the documents."""
    data = LOWER[piece.data]
    words = Words(piece)
    code = words.hashes(data)
    at, doc = windows(words.first, gram)
    short = np.flatnonzero((words.counts > 0) & (words.counts < gram))
    starts = np.concatenate([at, words.first[short]])
    ends = np.concatenate([at + gram, words.first[short + 1]])
    doc = np.concatenate([doc, short])
    h = range_hash(code, starts, ends)
    _, i = np.unique(h ^ mix(doc.astype(np.uint64)), return_index=True)
    i.sort()
    h, doc = h[i], doc[i]
    if len(short):
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def _classes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and an order-free hash of each."""
    sizes = np.bincount(doc, minlength=n)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ U64(0x2545F4914F6CDD1D)), out=total[1:])
    ends = np.cumsum(sizes)
    return sizes, mix((total[ends] - total[ends - sizes]) ^ mix(sizes.astype(np.uint64)))


def parity_bits(n: np.ndarray) -> np.ndarray:
    """Length of the bitmap of sets of n n-grams: a power of two, at least a bit for each of them until the most."""
    bits = 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    return np.clip(bits, LEAST_PARITY, MOST_PARITY)


def _parities(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The parity bitmap of each set: bit h mod length is flipped by each n-gram h."""
    bits = parity_bits(sizes)
    ends = np.cumsum(bits)
    at = (h & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(ends - bits, sizes)
    odd = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little")
    return [odd[(e - b) >> 3 : e >> 3].tobytes() for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def _folded(parity: bytes, size: int) -> np.ndarray:
    """A bitmap at a shorter length of `size` bytes."""
    words = np.frombuffer(parity, np.uint64).reshape(-1, size >> 3)
    return np.bitwise_xor.reduce(words, axis=0)


def _may_link(mine: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether bitmaps differ in so few bits that the sets can reach the overlap."""
    apart = np.bitwise_count(mine ^ others).sum(axis=1, dtype=np.int64)
    return apart <= size + sizes - 2 * shape.overlap(size, sizes)


def cell_bits(size: int) -> int:
    """Bits of the sketch for `size` bytes of text."""
    return min(max(int(size // CELL_BYTES).bit_length(), CELL_BITS[0]), CELL_BITS[1])


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _sketch_rows(count: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = len(count) // SLICES
    for i in range(SLICES):
        cols = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([pack(count[i * size : (i + 1) * size])], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "class", "parity", "part", "counts"])


def scan_sets(docs: DataFrame, shape: Shape, text: str, bits: int) -> DataFrame:
    """A row for each document (size and class of its set), and sketch slices for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sizes, names, parities = [], [], []
            for piece in pieces(batch.column("text")):
                h, doc = gram_sets(piece, shape.gram)
                cells, times = np.unique(_cell(h, bits), return_counts=True)
                count[cells] += times.astype(np.uint32)
                s, c = _classes(h, doc, len(piece))
                parities += _parities(h, s)
                sizes.append(s)
                names.append(c)
            n = batch.num_rows
            size = np.concatenate([np.zeros(0, np.int64), *sizes])
            name = np.concatenate([np.zeros(0, np.uint64), *names]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(name, mask=size == 0), pa.array(parities, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "n_shingles", "class", "parity", "part", "counts"])
        if count.any():
            yield from _sketch_rows(count)

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text")), run, "doc_id long, n_shingles long, class long, parity binary, part int, counts binary")


def _merge_slices(table: pa.Table) -> pa.Table:
    """The ranks of a slice's cells, from the sums of their counts."""
    total = np.int64(0)
    for x in table["counts"]:
        total = total + unpack(x.as_py(), np.uint32)
    return rows_of({"part": [table["part"][0].as_py()], "counts": [pack(_rank(total).astype(np.uint8))]}, _arrow("part int, counts binary"))


def _rank(count: np.ndarray) -> np.ndarray:
    """Coarse, monotone rank of a count: noise among the rare is one rank, hot n-grams are last."""
    return np.minimum(8 * np.log2(np.maximum(count, 1)), MAX_RANK).astype(np.uint64)


def prefix_postings(docs: DataFrame, ranks, shape: Shape, parts: int, text: str, bits: int) -> DataFrame:
    """Packed postings of the rarest n-grams of every class, a class once a task."""

    def rows(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gram, name, size, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((name, gram))
        order = order[group_starts(gram[order], name[order])]
        gram, name, size, place = gram[order], name[order].view(np.int64), size[order].astype(np.int32), place[order].astype(np.int32)
        pairs, long, lead = _long_lists(gram, name, size, place, shape, TASK_LIST)
        sent, own = np.flatnonzero(~long | lead), np.flatnonzero(long & ~lead)
        schema = _arrow(_POSTINGS)
        out: dict[str, list] = {f.name: [] for f in schema}
        split = list(split_by(hash_part(mix(gram[sent]), parts)))
        shares = zip(split, np.array_split(pairs, len(split)), np.array_split(own, len(split)), strict=True)
        for (p, r), pair, o in shares:  # what a task has done itself travels in even shares
            r = sent[r]
            values = [p, pack(gram[r], True), pack(name[r]), pack(size[r]), pack(place[r]), pack(lead[r]), pack(pair), pack(gram[o], True), pack(name[o]), pack(size[o]), pack(place[o])]
            for key, value in zip(schema.names, values, strict=True):
                out[key].append(value)
        yield from rows_of(out, schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        found, held = [], 0
        for batch in batches:
            for piece in pieces(batch.column("text")):
                h, doc = gram_sets(piece, shape.gram)
                if not len(h):
                    continue
                sizes, names = _classes(h, doc, len(piece))
                order = np.lexsort((h, rank[_cell(h, bits)], doc))
                h, doc = h[order], doc[order]
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = place < shape.prefix(sizes)[doc]
                found.append([h[keep], names[doc[keep]], sizes[doc[keep]], place[keep]])
                held += int(keep.sum())
                if held > TASK_POSTINGS:
                    yield from rows(found)
                    found, held = [], 0
        if held:
            yield from rows(found)

    return map_batches(docs.select(docs[text].alias("text")), run, _POSTINGS)


def _possible(size_a, place_a, size_b, place_b, shape: Shape) -> np.ndarray:
    """Length and positional filters for sets that meet at these places of the shared order."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    bound = 1 + np.minimum(size_a - place_a, size_b - place_b) - 1 + np.minimum(place_a, place_b)
    return (100 * small >= shape.percent * large) & (bound >= shape.overlap(size_a, size_b))


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i < j) of all pairs within each run."""
    row = np.repeat(starts, sizes)
    i = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - 1 - i
    a = np.repeat(row + i, left)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)


def _long_lists(gram, name, size, place, shape: Shape, least: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted postings: pairs of leaders of long lists (over `least` members) with their other
    members, as far as these are possible; which postings are in long lists; which are leaders. known
    marks lists that are long elsewhere."""
    starts = group_starts(gram)
    sizes = np.diff(np.append(starts, len(gram)))
    far = sizes > least
    if known is not None:
        far |= np.maximum.reduceat(known, starts) if len(starts) else far
    long, lead = np.repeat(far, sizes), np.zeros(len(gram), bool)
    lead[starts[far]] = True
    rest = np.flatnonzero(long & ~lead)
    first = np.repeat(starts, sizes)[rest]
    ok = _possible(size[first].astype(np.int64), place[first], size[rest].astype(np.int64), place[rest], shape)
    return np.stack([name[first[ok]], name[rest[ok]]], 1), long, lead


def first_pairs(postings: DataFrame, shape: Shape) -> DataFrame:
    """kind 0: candidate pairs (a, b) of classes. kind 1: postings (gram a, class b, size, place)
    of long posting lists, for the second round."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        col = lambda c, kind, delta=False, width=1: np.concatenate([unpack(x.as_py(), kind, delta, width) for x in table[c]])
        gram, name, size, place, led = col("grams", np.uint64, True), col("classes", np.int64), col("sizes", np.int32).astype(np.int64), col("places", np.int32).astype(np.int64), col("leads", bool)
        order = np.lexsort((~led, name, gram))  # of a class from several tasks the leading one
        order = order[group_starts(gram[order], name[order])]
        gram, name, size, place, led = gram[order], name[order], size[order], place[order], led[order]
        pairs, long, _ = _long_lists(gram, name, size, place, shape, SMALL_BUCKET, led)
        starts = group_starts(gram)
        sizes = np.diff(np.append(starts, len(gram)))
        small = (sizes > 1) & ~long[starts] if len(starts) else np.zeros(0, bool)
        a, b = _pairs_within(starts[small], sizes[small])
        ok = _possible(size[a], place[a], size[b], place[b], shape)
        pair = np.unique(np.concatenate([np.stack([name[a[ok]], name[b[ok]]], 1), pairs, col("own_pairs", np.int64, width=2)]), axis=0)
        none = np.zeros(len(pair), np.int32)
        rest = np.flatnonzero(long)
        gram, name, size, place = (np.concatenate([x[rest], y]) for x, y in ((gram, col("own_grams", np.uint64, True)), (name, col("own_classes", np.int64)), (size, col("own_sizes", np.int32)), (place, col("own_places", np.int32))))
        return pa.table(
            [
                pa.array(np.concatenate([none, np.ones(len(gram), np.int32)])),
                pa.array(np.concatenate([pair[:, 0], gram.view(np.int64)])),
                pa.array(np.concatenate([pair[:, 1], name])),
                pa.array(np.concatenate([none, size]).astype(np.int32)),
                pa.array(np.concatenate([none, place]).astype(np.int32)),
            ],
            schema=schema,
        )

    return grouped(postings, run, "kind int, a long, b long, size int, place int")


def bounded(pairs: DataFrame, reps: DataFrame, shape: Shape) -> DataFrame:
    """Pairs (a, b) whose parity bitmaps let them reach the overlap, before the sets move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            least = np.minimum([len(p) for p in x], [len(p) for p in y])
            keep = np.zeros(batch.num_rows, bool)
            for size in np.unique(least).tolist():
                r = np.flatnonzero(least == size)
                a, b = (np.stack([_folded(p[i], size) for i in r.tolist()]) for p in (x, y))
                keep[r] = _may_link(a, b, n[r], m[r], shape)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    side = lambda c: reps.select(F.col("class").alias(c), F.col("parity").alias(f"p{c}"), F.col("n_shingles").alias(f"n{c}"))
    return map_batches(pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "pa", "pb", "na", "nb"), run, "a long, b long")


def _earlier_lists(of: np.ndarray, bounds: np.ndarray, s: int, e: int, gram: int) -> np.ndarray:
    """For rows s to e of a list, bits of the lists before `gram` that each row is also in."""
    row = np.repeat(np.arange(e - s), np.diff(bounds[s : e + 1]))
    mine = of[bounds[s] : bounds[e]]
    before = mine < gram
    names, at = np.unique(mine[before], return_inverse=True)
    bits = np.zeros((e - s, -(-max(len(names), 1) // 8)), np.uint8)
    np.bitwise_or.at(bits, (row[before], at >> 3), (1 << (at & 7)).astype(np.uint8))
    return bits


def mixed_lists(long: DataFrame, shape: Shape) -> DataFrame:
    """long (gram, class, size, place, component) by list and pair of neighbouring bands of sizes,
    of those that hold several components; blocks says into how many each is cut.

    Sizes of linked sets differ by 100 / percent at most, so a list is cut into bands of that ratio and
    a class meets those of its own band and of the one below.
    """
    # bands a hair wider than the ratio, so that rounding never puts a possible pair two bands apart
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(log(100 / shape.percent) * 1.000001)).cast("int")
    placed = long.withColumn("band", band).withColumn("at", F.explode(F.array("band", F.col("band") + 1)))
    lists = placed.groupBy("gram", "at").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(F.col("band") == F.col("at")).alias("any_top"))
    lists = cut(lists.where("c0 <> c1 AND any_top").select("gram", "at", "blocks"))
    return cut(placed.join(lists, ["gram", "at"]))


def second_pairs(mixed: DataFrame, reps: DataFrame, shape: Shape, parts: int, number: int | None = None) -> DataFrame:
    """Pairs (a, b) of mixed_lists() whose components differ and whose bitmaps let them reach the overlap.
    What meets is cut into blocks of LIST_BLOCK, and every two blocks meet in a task of their own, so no
    list comes to one task whole. With a number, that of a round of leaders, each block is on its own and
    each member is in one pair with an earlier one at most; order and blocks differ from round to round.
    """
    seed = U64(0 if number is None else number + 1)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        turn = pa.array(mix(table["class"].to_numpy().view(np.uint64) + seed).view(np.int64))
        table = table.append_column("turn", turn).sort_by([(c, "ascending") for c in ("gram", "at", "lo", "hi", "turn")])
        gram, at, lo, hi, block, band, name, size, place, comp = (table[c].to_numpy().astype(np.int64) for c in ("gram", "at", "lo", "hi", "block", "band", "class", "size", "place", "component"))
        parities = table["parity"].to_pylist()
        lists = table["lists"].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        of, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
        found = [np.zeros((0, 2), np.int64)]
        starts = group_starts(gram, at, lo, hi)
        for s, e in zip(starts.tolist(), np.append(starts, len(gram))[1:].tolist(), strict=True):
            earlier = _earlier_lists(of, bounds, s, e, gram[s])
            shortest = min(map(len, parities[s:e]))  # sizes are near each other, so lengths are one or two
            parity = np.stack([_folded(p, shortest) for p in parities[s:e]])
            led = np.zeros(e - s, bool)
            for i in range(s, e - 1):  # a row against the rest of its list, or of the other block
                j = np.arange(i + 1, e)
                j = j[~led[j - s]]
                j = j[(comp[j] != comp[i]) & ((block[j] != block[i]) | (lo[s] == hi[s])) & (np.maximum(band[j], band[i]) == at[s])]
                j = j[_possible(size[i], place[i], size[j], place[j], shape)]
                j = j[~(earlier[j - s] & earlier[i - s]).any(1)]  # pairs that meet in an earlier list leave that one
                j = j[_may_link(parity[i - s], parity[j - s], size[i], size[j], shape)]
                if len(j):
                    led[j - s] = number is not None
                    found.append(np.stack([np.minimum(name[i], name[j]), np.maximum(name[i], name[j])], 1))
        pair = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=schema)

    by_class = mixed.select("class", "gram").distinct().groupBy("class").agg(F.sort_array(F.collect_list("gram")).alias("lists"))
    rows = mixed.join(by_class.hint("merge"), "class").join(reps.select("class", "parity").hint("merge"), "class").withColumn("block", F.pmod(F.xxhash64("class", F.lit(int(seed))), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if number is None else F.col("block")).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows = rows.select("gram", "at", "lo", "hi", "block", "band", "class", "size", "place", "component", "parity", "lists", F.pmod(F.xxhash64("gram", "at", "lo", "hi"), F.lit(parts)).cast("int").alias("part"))
    return grouped(rows, run, "a long, b long").distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, shape: Shape, text: str) -> DataFrame:
    """(class, grams) of the wanted classes, from one document (`rep`) of each.

    Tasks test documents against a fixed-size filter of the wanted ones, so texts stay where
    they are; sets that pass it by chance find no partner in the joins that follow.
    """
    name = wanted.selectExpr("class ^ shiftleft(rep, 44) ^ shiftleft(rep, 24) AS name")
    known = docs.sparkSession.sparkContext.broadcast(hash_filter(name, "name", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy().astype(np.int64).view(np.uint64)
            for piece in pieces(batch.column("text")):
                h, doc = gram_sets(piece, shape.gram)
                sizes, name = _classes(h, doc, len(piece))
                mine = rep[piece.rows]
                hit = np.flatnonzero((sizes > 0) & passes(name ^ (mine << U64(44)) ^ (mine << U64(24)), known.value))
                ends = np.cumsum(sizes)
                sets = [np.sort(h[ends[i] - sizes[i] : ends[i]]).tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(name[hit].view(np.int64)), pa.array(sets, pa.binary())], ["class", "grams"])

    read = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 62))).alias("rep"), docs[text].alias("text"))
    return map_batches(read, run, "class long, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = (np.arange(1, PIVOTS, dtype=np.uint64) << U64(60)).astype(np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ga"), batch.column("gb"), strict=True)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                need = int(shape.overlap(np.int64(len(a)), np.int64(len(b))))
                ca = np.diff(np.concatenate([[0], np.searchsorted(a, pivots), [len(a)]]))
                cb = np.diff(np.concatenate([[0], np.searchsorted(b, pivots), [len(b)]]))
                if np.minimum(ca, cb).sum() < need:
                    continue
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= shape.percent * (len(a) + len(b) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    with_b = pairs.join(sets.withColumnsRenamed({"class": "b", "grams": "gb"}).hint("merge"), "b")
    both = with_b.join(sets.withColumnsRenamed({"class": "a", "grams": "ga"}).hint("merge"), "a").select("a", "b", "ga", "gb")
    return map_batches(both, run, "a long, b long")


def link_groups(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class (null for an empty set) of every row."""
    size = text_bytes(docs, text)
    spark, shape, parts, bits = docs.sparkSession, Shape(gram, percent), n_parts(size), cell_bits(size)
    scanned = cut(scan_sets(docs, shape, text, bits))
    rows = scanned.where("part is null").select("doc_id", "n_shingles", "class", "parity")
    merged = grouped(scanned.where("part is not null").select("part", "counts"), _merge_slices, "part int, counts binary").collect()  # a byte a cell
    slices = {r["part"]: unpack(bytes(r["counts"]), np.uint8) for r in merged}
    empty = np.zeros((1 << bits) // SLICES, np.uint8)
    ranks = spark.sparkContext.broadcast(np.concatenate([slices.get(i, empty) for i in range(SLICES)]))

    low = F.lit(-(1 << 62))
    reps = cut(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc"), F.min(F.coalesce("doc_id", low)).alias("rep"), F.first("parity").alias("parity"), F.first("n_shingles").alias("n_shingles")))
    found = cut(first_pairs(prefix_postings(docs, ranks, shape, parts, text, bits), shape))

    # joins are merged on purpose: sides grow with the corpus, and the driver is to hold none of them
    def links(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(reps.select("class", "rep"), "class")
        return cut(verified(pairs, class_sets(docs, wanted, shape, text), shape).distinct())

    edges = links(bounded(cut(found.where("kind = 0").select("a", "b").distinct()), reps, shape))
    groups = cut(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    long = found.where("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("class"), "size", "place").dropDuplicates(["gram", "class"])

    def still_mixed(lists: DataFrame, groups: DataFrame) -> DataFrame:
        now = lists.join(groups.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        return mixed_lists(now, shape)

    folder = scratch(spark, "lists")  # what rounds hand on is written and read, as the plans of checkpoints grow with each round

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    mixed = kept(still_mixed(long, groups), "mixed")

    def met(number: int | None) -> bool:
        """Whether a round adds links."""
        nonlocal groups, mixed
        edges = kept(links(second_pairs(mixed, reps, shape, parts, number)), f"edges-{number}")
        if edges.isEmpty():
            return False
        groups = kept(joined(groups, edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), f"groups-{number}")
        mixed = kept(still_mixed(mixed.select(*long.columns).distinct(), groups), f"mixed-{number}")
        return True

    for number in range(LEADER_ROUNDS):
        if mixed.isEmpty() or not met(number):
            break
    if not mixed.isEmpty():
        met(None)
    labelled = reps.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_class = cut(cut(labelled.select("class", "component")).join(cut(least), "component").select("class", "component_id"))
    return rows.join(by_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that with the smallest id, a null id last, and of
    rows that share the id the one with the least hash. Rows without words are in no group.

    Links are those of the job, STAGE_PERCENT of runs of STAGE_GRAM words, not those of op3. Rows
    are written with a number once, so that each is decided on its own whatever its id.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    folder = scratch(spark, "near")
    docs.select(*cols, F.monotonically_increasing_id().alias("row")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    linked = cut(link_groups(rows.select(F.col("row").alias("doc_id"), "text"), STAGE_GRAM, STAGE_PERCENT).select(F.col("doc_id").alias("row"), "component_id"))
    shared = linked.groupBy("component_id").count().where("count > 1").select("component_id")
    many = cut(linked.join(shared.hint("merge"), "component_id"))  # merged: the driver holds no side of these joins
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*cols[1:]).alias("print"), "row")
    first = rows.select("row", order.alias("order")).join(many.hint("merge"), "row").groupBy("component_id").agg(F.min("order").alias("order"))
    gone = cut(many.select("row").join(first.select("order.row").hint("merge"), "row", "left_anti"))
    return rows.join(gone, "row", "left_anti").select(*cols)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over documents: GRAM words, PERCENT; nulls, ties and empty tables as the module says."""
    return link_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class")
