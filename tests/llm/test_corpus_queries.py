"""Corpus queries on the smallest tables: against SQL where there is some, else against brute-force
versions written from the contracts; and the pipeline, stage by stage, row by row."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_decontaminate import brute as share_of_item
from test_mixing import targets
from test_ngram_join import stage_groups
from test_pii import brute as base_spans

import corpus_pipeline
from tidemark.llm import decontaminate, mixing, queries, token_files

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())


def test_op4_matches_brute_force(spark, docs):
    rows = queries.QUERIES["op4_mixing"](spark, SF).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, queries.QUERIES["op4_mixing"](spark, SF).collect()))
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    whole = Counter()
    for d, n in size.items():
        whole[source[d]] += n
    want, taken = targets(whole), Counter()
    assert {r.doc_id: r["size"] for r in rows} == size
    for r in rows:
        assert r.source_size == whole[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"] and (r.first_shard is None) == (r.taken == 0)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= max(1, 2 * min(mixing.BLOCK, whole[s] // mixing.FINENESS)) for s, t in want.items())


def test_op5_matches_brute_force(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_pii"](spark, SF).collect()}
    assert set(rows) == {d for d, *_ in docs}
    for d, t, _ in docs:
        spans, r = base_spans(t), rows[d]
        name = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in spans) for x in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(name.encode()).hexdigest() and r.spans.startswith(name)
        added = [s.split(":") for s in r.spans[len(name) :].strip(",").split(",") if s]
        assert all(k in ("generalised", "removed") and 0 <= int(a) < int(b) <= len(t) for k, a, b in added) and (spans or not added)


def test_op7_matches_brute_force(spark, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    rows = {r.doc_id: r for r in queries.QUERIES["op7_licenses"](spark, SF).collect()}
    for d, t, _ in docs:
        words = PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        r = rows[d]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) or not r.labels


def test_op9_finds_every_whole_copy_and_only_overlaps(spark, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_decontaminate"](spark, SF).collect()}
    share = {(d, i): share_of_item(t, w) for d, t, _ in docs for i, w in items}
    assert {k for k, v in share.items() if v == 1} <= got
    assert all(share[k] > 0.2 for k in got)


def tokens(rows):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text) by the tokenizer as it is."""
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(token_files.tokenizer_path()), 0, []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op10_matches_brute_force(spark, docs):
    got = [tuple(r) for r in queries.QUERIES["op10_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == tokens((d, t) for d, t, _ in docs)


def test_pipeline_stage_by_stage(spark, con):
    """Each stage on what the one before has kept, against what must be kept of it."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = stage(spark, now, SF).persist()
        assert now.columns == COLS
        rows = now.collect()
        left = {r.doc_id for r in rows}
        assert len(left) == len(rows)
        if name == "quality rules":
            want = {d for (d,) in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op8_quality_rules']}) WHERE kept").fetchall()}
        elif name == "n-gram Jaccard join":
            group = stage_groups([(r.doc_id, r.text) for r in before])
            want = {min(before[i].doc_id for i in range(len(before)) if group[i] == g) for g in set(group)}
        elif name == "benchmark decontamination":
            items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
            df = spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string")
            found = {r.doc_id for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
            assert {r.doc_id for r in before if any(share_of_item(r.text, w) == 1 for _, w in items)} <= found
            want = {r.doc_id for r in before} - found
        else:
            df = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
            taken = {r.doc_id: r.taken for r in mixing.document_totals(df).collect()}
            want = {d for d, n in taken.items() if n}
            assert {r.doc_id: len(WORD.findall(r.text)) for r in rows} == {d: taken[d] for d in want}
        assert left == want, name
        if name != "mixing sources to target weights":
            assert set(map(tuple, rows)) <= set(map(tuple, before))
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, last)) == tokens(sorted((r.doc_id, r.text) for r in now.collect()))


def test_run_writes_and_rereads(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
