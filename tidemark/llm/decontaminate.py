"""Benchmark decontamination: BM25 over test items, pruned by block maxima, then verified.

Index. Each test item is cut into entries of at most ENTRY words; an entry's impact for a term is
its BM25 weight as a share of the entry's score for itself. Entries are ordered by length and
held in BLOCKS blocks, and for each term the largest impact in each block is kept.

Search. Every passage of every document (two steps of ENTRY words, starting each step) is a
query. As in block-max WAND, a block whose maxima for the passage's terms add up to less than
THRESHOLD is skipped. In the others the terms are put in order of their maxima, and the pivot is
the first at which the sum of maxima so far reaches THRESHOLD: an entry that holds no term from the
pivot on cannot reach it and is skipped too. What is left is scored exactly; all entries at or over
the threshold are retrieved. Any ENTRY consecutive words lie in one passage whole.

Verification. Around a hit the item's runs of RUN words are looked for; a word of the item is
found if a run that holds it is there, so an edited word costs itself and at most RUN - 1 words on
either side. A document is contaminated by an item if at least PART_SHARE of the words of its question
and of those of its answer (its last sentence) are found. An item of fewer than GRAM words must
be there whole.

Indexes hold about INDEX_ITEMS items or INDEX_WORDS words and are broadcast, SCAN_INDEXES at a time:
so many are searched in one reading of the documents. What is broadcast does not grow with the
benchmark; statistics cover all items.

An item is a distinct pair of id and text: items that share an id are each searched for and
reported, and so are items with a null id, with that id.

Nulls: null texts are empty and match nothing; items without words are left out. Repeated rows
are reported for each row. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.licenses import NOT_WORD
from tidemark.llm.textkit import BYTE_CODES, LOWER, Words, covered, map_batches, pieces, range_hash

K1, B = 1.2, 0.75
ENTRY = 32
BLOCKS = 16
THRESHOLD = 0.7
GRAM = 5
RUN = 3
SHARE = 0.8  # of five-word runs: a whole copy, to tests; the search has no such threshold
PART_SHARE = 0.5
INDEX_ITEMS = 1000
INDEX_WORDS = 200_000
SCAN_INDEXES = 8
PAIRS = 1000  # passages and blocks that are scored at once
NEAR = 1e-4  # maxima are rounded to 32 bits

_HITS = "array<struct<item_id: long, score: double, share: double, question_share: double, answer_share: double, first_word: long>>"
_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("share", pa.float64()), ("question_share", pa.float64()), ("answer_share", pa.float64()), ("first_word", pa.int64())]))


def _word_codes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    piece = next(pieces(pa.array([text])))
    words = Words(piece, NOT_WORD)
    return range_hash(BYTE_CODES[LOWER[data]], words.starts, words.ends)


def _runs(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, in order."""
    at = np.arange(max(len(codes) - width + 1, 0))
    return range_hash(codes, at, at + width)


class Part:
    """Runs of a text, of RUN words or of all its words if these are fewer (whole: than GRAM)."""

    def __init__(self, text: str, whole: bool = False):
        codes = _word_codes(text)
        self.length = len(codes)
        self.width = self.length if self.length < (GRAM if whole else RUN) else RUN
        self.runs = _runs(codes, self.width) if self.width else codes

    def share_in(self, around: np.ndarray) -> float:
        """Share of the words that stand in a run that is also around."""
        if not len(self.runs):
            return 1.0
        there = np.flatnonzero(np.isin(self.runs, _runs(around, self.width)))
        return float(covered(there, self.width, self.length).mean())


def _question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; of a single sentence, the last third of its words."""
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    if cuts:
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split()
    k = len(words) - max(len(words) // 3, 1)
    return " ".join(words[:k]), " ".join(words[k:])


class Index:
    """A block of items, with statistics (n, average length, document frequencies) of all."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, mean: float, frequency: dict[int, int]):
        entries = []
        self.ids = [item_id for item_id, _ in items]
        self.items = []  # by place in the block, as ids may repeat
        for place, (_, text) in enumerate(items):
            codes = _word_codes(text)
            self.items.append([Part(text, True), *map(Part, _question_and_answer(text))])
            k = -(-len(codes) // ENTRY)
            entries += [(part, place) for part in np.array_split(codes, k)]
        entries.sort(key=lambda e: (len(e[0]), e[1]))
        self.owner = np.array([e[1] for e in entries], np.int64)
        self.terms = np.unique(np.concatenate([e[0] for e in entries]))
        self.own = np.zeros(len(entries))
        postings = []
        for j, (codes, _) in enumerate(entries):
            t, tf = np.unique(codes, return_counts=True)
            df = np.array([frequency[int(x)] for x in t])
            weight = np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(codes) / mean))
            self.own[j] = weight.sum()
            postings.append((np.searchsorted(self.terms, t), np.full(len(t), j), weight / self.own[j]))
        term, entry, impact = (np.concatenate(x) for x in zip(*postings, strict=True))
        order = np.lexsort((entry, term))
        self.entry, self.impact = entry[order], impact[order]
        self.block = np.arange(len(entries)) * BLOCKS // len(entries)
        cell = term[order] * BLOCKS + self.block[self.entry]
        self.first = np.searchsorted(cell, np.arange(len(self.terms) * BLOCKS + 1))  # postings of term t in block b
        self.maxima = np.zeros((len(self.terms), BLOCKS), np.float32)
        np.maximum.at(self.maxima, (term, self.block[entry]), impact.astype(np.float32))
        self.scored = 0  # entries scored so far

    def retrieve(self, pair: np.ndarray, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For many passages at once, each with a block: (pair, entry, score) of the entries at or over
        THRESHOLD. pair and term list the distinct terms of each pair; block is that of each pair."""
        cell = term * BLOCKS + block[pair]
        top = self.maxima.ravel()[cell]
        order = np.lexsort((top, pair))
        order = order[top[order] > 0]
        pair, cell, top = pair[order], cell[order], top[order].astype(float)
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        upto = np.cumsum(top)
        upto -= np.repeat(upto[starts] - top[starts], np.diff(np.append(starts, len(pair))))
        n = self.first[cell + 1] - self.first[cell]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[cell], n)
        key = np.repeat(pair, n) * len(self.own) + self.entry[at]
        candidates = np.unique(key[np.repeat(upto >= THRESHOLD - NEAR, n)])  # entries with a term from the pivot on
        self.scored += len(candidates)
        if not len(candidates):
            return candidates, candidates, np.zeros(0)
        place = np.minimum(np.searchsorted(candidates, key), len(candidates) - 1)
        known = candidates[place] == key
        score = np.bincount(place[known], self.impact[at[known]], len(candidates))
        hit = score >= THRESHOLD
        return candidates[hit] // len(self.own), candidates[hit] % len(self.own), score[hit]


def index_groups(items: DataFrame) -> Iterator[list[Index]]:
    """The indexes that one reading of the documents searches."""
    indexes = build_indexes(items)
    while group := list(islice(indexes, SCAN_INDEXES)):
        yield group


def build_indexes(items: DataFrame) -> Iterator[Index]:
    """One index for each block of items. Counts are made in Spark; a block is bounded."""
    spark = items.sparkSession
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).where("text is not null").dropDuplicates(["item_id", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.unique(_word_codes(t.as_py()), return_counts=True) for t in batch.column("text")]
            lengths = [int(n.sum()) for _, n in codes]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array(lengths, pa.int64()), pa.array([c.view(np.int64).tolist() for c, _ in codes], pa.list_(pa.int64()))], ["item_id", "text", "length", "terms"])

    counted = map_batches(rows, count, "item_id long, text string, length long, terms array<long>").where("length > 0").cache()
    total = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum("length").alias("words")).first()
    blocks = max(-(-total["n"] // INDEX_ITEMS), -(-(total["words"] or 0) // INDEX_WORDS))
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))))
    frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    for b in range(blocks):
        mine = dealt.where(F.col("block") == b)
        known = frequencies.join(mine.select(F.explode("terms").alias("term")).distinct(), "term").collect()
        texts = sorted(((r.item_id, r.text) for r in mine.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # about INDEX_ITEMS
        if texts:
            yield Index(texts, total["n"], total["mean"], {r["term"] & (1 << 64) - 1: r["count"] for r in known})
    counted.unpersist()


def _search(index: Index, words: Words, codes: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(row, entry, score, first word of the passage) of every passage and entry over THRESHOLD."""
    term = np.minimum(np.searchsorted(index.terms, codes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[term] == codes)
    if not len(hit):
        return
    # steps of ENTRY words, numbered through the piece; a document starts a new one
    steps = -(-words.counts // ENTRY)
    first_step = np.cumsum(steps) - steps
    doc = words.doc[hit]
    step = first_step[doc] + (hit - words.first[doc]) // ENTRY
    key = np.unique(step * len(index.terms) + term[hit])
    step, term = key // len(index.terms), key % len(index.terms)
    n = int(steps.sum())
    bound = np.zeros((n + 1, index.maxima.shape[1]), np.float32)
    starts = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
    bound[step[starts]] = np.add.reduceat(index.maxima[term], starts, axis=0)
    step_doc = np.repeat(np.arange(len(steps)), steps)
    joined = np.append(step_doc[1:] == step_doc[:-1], False)[:n] if n else np.zeros(0, bool)
    bound = bound[:n] + np.where(joined[:, None], bound[1:], 0)
    passages, blocks = np.nonzero(bound >= THRESHOLD - NEAR)
    ends = np.append(starts[1:], len(step))
    lists = np.zeros((n + 1, 2), np.int64)  # terms of each step
    lists[step[starts]] = np.stack([starts, ends], 1)
    for c in range(0, len(passages), PAIRS):
        some, block = passages[c : c + PAIRS], blocks[c : c + PAIRS]
        # a passage's terms are those of its step and, within the document, of the next one
        one, two = lists[some], np.where(joined[some][:, None], lists[some + 1], 0)
        begin, size = np.concatenate([one[:, 0], two[:, 0]]), np.concatenate([one[:, 1] - one[:, 0], two[:, 1] - two[:, 0]])
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        own = np.unique(np.repeat(np.concatenate([np.arange(len(some))] * 2), size) * len(index.terms) + term[at])
        for k, e, score in zip(*(x.tolist() for x in index.retrieve(own // len(index.terms), own % len(index.terms), block)), strict=True):
            d = int(step_doc[some[k]])
            yield d, e, score * float(index.own[e]), int((some[k] - first_step[d]) * ENTRY)


def contamination(docs: DataFrame, indexes: list[Index], keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and `hits`: the items of the indexes found in each document, best first."""
    sent = docs.sparkSession.sparkContext.broadcast(indexes)

    def found_in(index: Index, words: Words, codes: np.ndarray) -> Iterator[tuple[int, dict]]:
        best: dict[tuple[int, int], dict] = {}
        for row, entry, score, word in _search(index, words, codes):
            item = int(index.owner[entry])
            whole, question, answer = index.items[item]
            lo = max(int(words.first[row]), int(words.first[row]) + word - whole.length)
            hi = min(int(words.first[row + 1]), int(words.first[row]) + word + 2 * ENTRY + whole.length)
            around = codes[lo:hi]
            if whole.length < GRAM and whole.share_in(around) < 1:
                continue
            found = {"item_id": index.ids[item], "score": score, "share": whole.share_in(around), "question_share": question.share_in(around), "answer_share": answer.share_in(around), "first_word": word}
            if min(found["question_share"], found["answer_share"]) < PART_SHARE:
                continue
            old = best.get((row, item))
            if old is None or (found["share"], found["score"]) > (old["share"], old["score"]):
                best[row, item] = found
        return ((row, found) for (row, _), found in best.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for piece in pieces(batch.column("_text")):
                words = Words(piece, NOT_WORD)
                codes = range_hash(BYTE_CODES[LOWER[piece.data]], words.starts, words.ends)
                for index in sent.value:
                    for row, found in found_in(index, words, codes):
                        hits[piece.rows[row]].append(found)
            for h in hits:
                h.sort(key=lambda x: (-x["share"], -x["score"], x["item_id"] is None, x["item_id"] or 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(hits, _HIT_TYPE)], [*(f"k{i}" for i in range(len(keep))), "hits"])

    kinds = dict(docs.dtypes)
    read = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text].alias("_text"))
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), f"hits {_HITS}"])
    return map_batches(read, run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    parts = [contamination(docs, group, ["doc_id"]).where(F.size("hits") > 0) for group in index_groups(items)]
    empty = docs.sparkSession.createDataFrame([], f"doc_id long, hits {_HITS}")
    return reduce(DataFrame.unionByName, parts, empty).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, each decided on its own text: rows with a null
    text or id, repeated rows and ties stay like others. An empty table gives an empty table, an empty
    benchmark leaves all."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    out = docs.select(*cols)
    for group in index_groups(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        out = contamination(out, group, cols).where(F.size("hits") == 0).select(*cols)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over documents and benchmark; nulls, ties and empty tables as the module says."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
