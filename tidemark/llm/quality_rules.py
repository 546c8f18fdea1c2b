"""Quality rules with host-level verdicts.

A document fails the base rules with fewer than MIN_WORDS words, or with over REPEAT_PCT % of
its words in repeated windows. Softer rules (symbols, repeated lines, odd word lengths) mark a
document as suspect. Failures of either kind are counted by host, the rate of each host is
shrunk by a beta prior fitted to all hosts, and the verdict is joined back: a suspect document
of a host whose shrunk rate is over HOST_RATE is rejected. A document that fails no rule is
kept whatever its host.

Nulls: a null text has no words (so fails the base rules); null hosts form one host of their
own. An empty table gives an empty table. Repeated rows are judged one by one. Columns other
than those named here are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.joins import join_side
from tidemark.llm.textkit import BYTE_CODES, Words, covered, map_batches, mix, pieces, range_hash, windows
from tidemark.session import cut

MIN_WORDS = 10
REPEAT_PCT = 20
WINDOW = 5
SYMBOL_SHARE = 0.10
DUP_LINE_SHARE = 0.30
WORD_LENGTH = (2.0, 15.0)
HOST_RATE = 0.5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NOT_NEWLINE = np.arange(256) == 10


def _counts(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values within first[i]:first[i + 1], for every i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _repeats(codes: np.ndarray) -> np.ndarray:
    """Which codes occur twice or more."""
    _, back, n = np.unique(codes, return_inverse=True, return_counts=True)
    return n[back] > 1


def _piece_stats(piece) -> list[np.ndarray]:
    n = len(piece)
    words = Words(piece)
    starts_char = (piece.data & 0xC0) != 0x80
    chars = np.zeros(len(piece.data) + 1, np.int64)
    np.cumsum(starts_char, out=chars[1:])
    word_chars = np.bincount(words.doc, chars[words.ends] - chars[words.starts], n).astype(np.int64)
    symbols = _counts(_SYMBOL[piece.data], piece.offsets)

    lines = Words(piece, _NOT_NEWLINE)
    lo = np.searchsorted(words.starts, lines.starts)
    has_word = (lo < len(words.starts)) & (np.append(words.starts, len(piece.data))[lo] < lines.ends)
    n_lines = np.bincount(lines.doc[has_word], minlength=n)
    code = range_hash(BYTE_CODES[piece.data], lines.starts, lines.ends)[has_word] ^ mix(lines.doc[has_word].astype(np.uint64))
    distinct = np.unique(code, return_index=True)[1]
    dup_lines = n_lines - np.bincount(lines.doc[has_word][distinct], minlength=n)

    at, doc = windows(words.first, WINDOW)
    code = range_hash(words.hashes(piece.data), at, at + WINDOW) ^ mix(doc.astype(np.uint64))
    repeated = covered(at[_repeats(code)], WINDOW, len(words.starts))
    return [words.counts, word_chars, symbols, dup_lines, _counts(repeated, words.first), n_lines]


def rule_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the rule statistics of `text`, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_piece_stats(p) for p in pieces(batch.column("_text"))]
            cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] or [pa.array([], pa.int64())] * len(STATS)
            kept = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *cols], [*(f"k{i}" for i in range(len(keep))), *STATS])

    read = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text].alias("_text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), *(f"{s} long" for s in STATS)])
    return map_batches(read, run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words"))


def suspect() -> Column:
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return (
        (F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars"))
        | (F.col("n_dup_lines") > DUP_LINE_SHARE * F.greatest(F.col("n_lines"), F.lit(1)))
        | (length < WORD_LENGTH[0])
        | (length > WORD_LENGTH[1])
    )


def host_verdicts(stats: DataFrame, host: str) -> DataFrame:
    """One row a host: documents, failures, shrunk failure rate, verdict."""
    by_host = stats.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum((base_failed() | suspect()).cast("long")).alias("host_failures"))
    by_host = cut(by_host)
    rate = F.col("host_failures") / F.col("host_docs")
    prior = by_host.agg(F.sum("host_failures").alias("f"), F.sum("host_docs").alias("n"), F.count("*").alias("k"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inv")).first()
    mean = (prior["f"] or 0) / prior["n"] if prior["n"] else 0.0
    within = mean * (1 - mean) * (prior["inv"] or 0.0)
    between = max((prior["v"] or 0.0) - within, 0.0)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4) if between > 0 else 1e4
    a, b = max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)
    shrunk = (F.col("host_failures") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return by_host.select(host, shrunk.alias("host_rate"), (shrunk > HOST_RATE).alias("host_rejected"))


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """Columns `keep`, the statistics, base_failed, suspect, host_rate and kept.

    Statistics are made once and written, unless `keep` has the text: writing that once more costs
    more than reading it twice.
    """
    stats = rule_stats(docs, list(dict.fromkeys([*keep, host])), text)
    if text not in keep:
        stats = cut(stats)
    hosts = host_verdicts(rule_stats(docs, [host], text) if text in keep else stats, host)
    joined = join_side(stats, hosts, host, F.struct("n_words", "word_chars", "n_symbols"))
    bad = base_failed()
    return joined.select(
        *dict.fromkeys([*keep, host]), *STATS, bad.alias("base_failed"), suspect().alias("suspect"), "host_rate",
        (~bad & ~(F.coalesce("host_rejected", F.lit(False)) & suspect())).alias("kept"),
    )


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, with their columns as they were: rows with a null text or fewer than
    MIN_WORDS words go, null ids and hosts are judged like others, repeated rows one by one. An empty
    table gives an empty table."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    return judge(docs, cols).filter("kept").select(*cols)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over documents; nulls, ties and empty tables as the module says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "suspect")
