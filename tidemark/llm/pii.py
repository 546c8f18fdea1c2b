"""Personal data: fixed patterns, and terms that disclose the entities these patterns find.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. The method adds
terms by information content. An entity is a base value; it co-occurs with the CONTEXT nearest
words on either side that belong to no base value, however long or far off these are, so that pairs
grow with the text and not with its square. Over the corpus, with N documents, df(x) documents that
hold x and c(e, t) documents in which term t co-occurs with entity e:

    PMI(e; t) = ln(N * c(e, t) / (df(e) * df(t)))        IC(e) = ln(N / df(e))

A term that says everything about an entity has PMI = IC. Terms with c >= SUPPORT and
PMI >= REMOVE * IC are removed, those with PMI >= GENERALISE * IC generalised: in every document that
holds the entity, each place of the term is an added span. A generalised term is replaced by its
class, the kind of entity that it co-occurs with most often in the corpus; base values are replaced
by their kind. Counts cover all documents. Entities in fewer than SUPPORT documents give no estimate
and so no terms.

Nulls: a null text is empty, a null doc_id stays null. Repeated rows are counted as documents.
Offsets are code points, ends exclusive. An empty table gives an empty table. Extra columns are not
read. Entities and terms are named by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.joins import hash_filter, passes
from tidemark.llm.textkit import BYTE_CODES, LOWER, Words, map_batches, pieces, range_hash
from tidemark.session import cut

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 10
SUPPORT = 3
GENERALISE = 0.75
REMOVE = 0.95
FILTER_BITS = (16, 27)  # the least, the most

# What is found equals the patterns of the contract; possessive runs and the look-behinds only
# keep long runs of one class from being tried again from each of their characters.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_EDGES = ".,;:!?()[]{}\"'"
_LOWER = {c: c + 32 for c in range(65, 91)}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _name(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _free_words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], list[int], list[int]]:
    """Words that touch no base span, without punctuation at their ends: terms, starts, ends."""
    at = sorted(a for _, a, _ in spans)
    reach = list(accumulate((b for _, b in sorted((a, b) for _, a, b in spans)), max))
    terms, starts, ends = [], [], []
    for m in _WORD.finditer(text):
        i = bisect_left(at, m.end())
        if i and reach[i - 1] > m.start():
            continue
        core = m[0].strip(_EDGES)
        if core:
            s = m.start() + len(m[0]) - len(m[0].lstrip(_EDGES))
            terms.append(core.translate(_LOWER))
            starts.append(s)
            ends.append(s + len(core))
    return terms, starts, ends


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    return [f"{kind}:{text[a:b].lower()}" for kind, a, b in spans]


def _hash_terms(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return range_hash(BYTE_CODES[data], np.concatenate([np.zeros(1, np.int64), ends[:-1]]), ends).view(np.int64) if raw else np.zeros(0, np.int64)


def _pair(entity: np.ndarray, term: np.ndarray) -> np.ndarray:
    """One number for an entity and a term; PAIR is the same in SQL."""
    term = term.view(np.uint64)
    return entity.view(np.uint64) ^ (term << np.uint64(21)) ^ (term >> np.uint64(43))


PAIR = "entity ^ shiftleft(term, 21) ^ shiftrightunsigned(term, 43)"


def scan_entities(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """Base result of each document, and what its entities co-occur with. The text is kept of
    documents with entities, or of all."""
    fields = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<entity: long, term: long, kind: int>>, text string"
    kind = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("kind", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, lengths, texts = [], [], [], []
            named: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
            for value in batch.column("text"):
                t = value.as_py() or ""
                spans = base_spans(t)
                counts.append([sum(s[0] == k for s in spans) for k in KINDS])
                base.append(_name(spans))
                texts.append(value.as_py() if spans or whole else None)
                lengths.append(0)
                if spans:
                    terms, starts, ends = _free_words(t, spans)
                    code, entity = _hash_terms(terms), _hash_terms(_entities(t, spans))
                    for e, (k, a, b) in zip(entity.tolist(), spans, strict=True):
                        near = np.unique(code[max(0, bisect_left(ends, a + 1) - CONTEXT) : bisect_left(starts, b) + CONTEXT])
                        named.append(np.stack([np.full(len(near), e), near, np.full(len(near), KINDS.index(k))], 1))
                        lengths[-1] += len(near)
            e, t, k = np.concatenate(named).T
            items = pa.StructArray.from_arrays([pa.array(e), pa.array(t), pa.array(k.astype(np.int32))], ["entity", "term", "kind"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), items).cast(kind)
            by_kind = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *by_kind, pa.array(base, pa.string()), lists, pa.array(texts, pa.string())], ["doc_id", "row", *(f"n_{k}" for k in KINDS), "base", "near", "text"])

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), docs[text].alias("text"))
    return map_batches(read, run, fields)


def _filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """hash_filter() of about 16 bits for each hash, within FILTER_BITS."""
    least, most = FILTER_BITS
    return hash_filter(hashes, column, min(max(least, (16 * hashes.count()).bit_length()), most))


def term_documents(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): documents of the whole corpus that hold each candidate term.

    Tasks first test words against a bounded set of bits for the terms; words that pass are counted
    by task, summed, and joined with the terms.
    """
    bits = _filter_of(terms, "term")
    known = docs.sparkSession.sparkContext.broadcast(bits)
    edge = np.zeros(256, bool)
    edge[[ord(c) for c in _EDGES]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        bits = known.value
        for batch in batches:
            for piece in pieces(batch.column("text")):
                data = LOWER[piece.data]
                words = Words(piece)
                s, e = words.starts.copy(), words.ends.copy()
                open_ = np.arange(len(s))
                while len(open_):
                    open_ = open_[(s[open_] < e[open_]) & edge[data[s[open_]]]]
                    s[open_] += 1
                open_ = np.arange(len(s))
                while len(open_):
                    open_ = open_[(s[open_] < e[open_]) & edge[data[e[open_] - 1]]]
                    e[open_] -= 1
                h = range_hash(BYTE_CODES[data], s, e)
                hit = passes(h, bits)
                pair = np.unique(np.stack([words.doc[hit], h[hit].view(np.int64)], 1), axis=0)
                for t, n in zip(*(x.tolist() for x in np.unique(pair[:, 1], return_counts=True)), strict=True):
                    total[t] = total.get(t, 0) + n
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return map_batches(docs.select(docs[text].alias("text")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(scanned: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, kind, class): what is to be generalised or removed where the entity occurs."""
    pairs = scanned.select(F.explode(F.array_distinct("near")).alias("p")).groupBy("p.entity", "p.term", "p.kind").agg(F.count("*").alias("c")).where(F.col("c") >= SUPPORT)
    pairs = cut(pairs.withColumnRenamed("kind", "kind_no"))
    entity = F.explode(F.array_distinct(F.transform("near", lambda n: n["entity"])))
    entities = scanned.select(entity.alias("entity")).groupBy("entity").agg(F.count("*").alias("e")).where(F.col("e") >= SUPPORT)
    holding = term_documents(docs, pairs.select("term").distinct(), text)
    classes = pairs.groupBy("term", "kind_no").agg(F.sum("c").alias("c")).groupBy("term").agg(F.max_by("kind_no", F.struct("c", -F.col("kind_no"))).alias("class"))
    total = F.lit(float(max(scanned.count(), 1)))
    scored = pairs.join(entities, "entity").join(holding, "term").join(classes, "term")
    pmi, ic = F.log(total * F.col("c") / (F.col("e") * F.col("n"))), F.log(total / F.col("e"))
    kind = F.when(pmi >= REMOVE * ic, "removed").when(pmi >= GENERALISE * ic, "generalised")
    return scored.where(ic > 0).select("entity", "term", kind.alias("kind"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("class") + 1).alias("class"), pmi.alias("pmi"), ic.alias("ic")).where("kind is not null")


def term_places(scanned: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, start, end, kind, class) of every place of a disclosing term in documents of its entity.

    Tasks test the words and entities of a document against a bounded set of bits; what passes is
    joined with the terms.
    """
    known = scanned.sparkSession.sparkContext.broadcast(_filter_of(terms.select(F.expr(PAIR).alias("pair")), "pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                t = value.as_py()
                spans = base_spans(t)
                words, starts, ends = _free_words(t, spans)
                code, starts, ends = _hash_terms(words), np.array(starts, np.int64), np.array(ends, np.int64)
                for e in np.unique(_hash_terms(_entities(t, spans))):
                    entity = np.full(len(code), e)
                    hit = passes(_pair(entity, code), known.value)
                    if hit.any():
                        cols = [np.full(int(hit.sum()), row), entity[hit], code[hit], starts[hit], ends[hit]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "entity", "term", "start", "end"])

    holders = scanned.where("base <> ''").select("row", "text")
    return map_batches(holders, run, "row long, entity long, term long, start long, end long").join(terms.select("entity", "term", "kind", "class"), ["entity", "term"]).drop("entity", "term")


def with_spans(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, counts, base, found (places of disclosing terms, in order) and text of each document."""
    scanned = cut(scan_entities(docs, text, whole))
    terms = cut(disclosing_terms(scanned, docs, text))
    place = F.struct(F.when(F.col("kind") == "generalised", 1).otherwise(2).alias("order"), "start", "end", "kind", "class")
    added = term_places(scanned, terms).groupBy("row").agg(F.array_sort(F.collect_set(place)).alias("found"))
    return scanned.drop("near").join(added, "row", "left").drop("row")


def sanitise(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each (start, end, what) replaced by <what>, or by nothing if this is empty."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b, what in sorted(spans):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{what}>" if what else ""]
        at = b
    return "".join(out) + text[at:]


def sanitised(found: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of with_spans() and its text without base values and disclosing terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, base, places in zip(batch.column("text"), batch.column("base"), batch.column("found"), strict=True):
                spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.as_py().split(",") if s)]
                spans += [(p["start"], p["end"], "" if p["kind"] == "removed" else f"{p['class']}-related") for p in places.as_py() or []]
                out.append(sanitise(t.as_py(), spans))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    kinds = dict(found.dtypes)
    return map_batches(found.select(*dict.fromkeys([*keep, "base", "found", "text"])), run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "text string"]))


def sanitised_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and sanitised text of every document; a null text stays null."""
    return sanitised(with_spans(docs, text, True), ["doc_id"])


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, spans, and the digest of the sanitised text (null where there is no span)."""
    counts = [f"n_{k}" for k in KINDS]
    named = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    found = with_spans(docs, text).withColumn("named", F.array_join(named, ","))
    out = sanitised(found, ["doc_id", *counts, "base", "named"])
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "named")
    return out.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), every.alias("spans"), F.when(F.col("base") != "", F.sha2("text", 256)).alias("sanitised_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over documents; nulls, ties and empty tables as the module says."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
