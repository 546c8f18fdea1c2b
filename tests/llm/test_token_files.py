import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_files as t
from tidemark.llm.textkit import pieces


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(t.tokenizer_path())
    tok.encode_special_tokens = True
    return tok


def brute(tokenizer, rows):
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab's_-,|é学 \n\t  　\x1c1!.\u0085😀", max_size=30), min_size=1, max_size=4))
def test_cut_pieces_encode_as_whole_texts(tokenizer, texts):
    encoder = t.Encoder.of(t.tokenizer_path())
    for piece in pieces(pa.array(texts)):
        ids, counts = encoder.encode(piece)
        want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 4096, 10_001])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    payload, ends = t.encode_chunk(ids, mode, 4096)
    assert (t.decode_chunk(payload, ends, n, mode, 4096) == ids).all()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_files_match_brute_force(spark, tokenizer, mode, monkeypatch):
    rnd = random.Random(6)
    text = lambda: "".join(rnd.choice(["the ", "été ", "x", " ", "\n", "don't ", "12 ", "<|endoftext|>"]) for _ in range(rnd.randint(0, 80)))
    rows = [(i * 3, text()) for i in range(150)] + [(1, None), (2, ""), (None, "null id"), (4, "long word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in t.tokens_of(df, mode=mode).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(tokenizer, rows)


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 3), (1, "a b", 4), (0, "c", 5)], "doc_id long, text string, part int")
    got = sorted(tuple(r) for r in t.tokens_of(df).select("doc_id", "start", "n_tokens").collect())
    assert got == [(0, 0, 2), (1, 2, 3), (1, 5, 3)]
    assert t.tokens_of(df.limit(0)).count() == 0


def test_cache_starts_again_when_full(tokenizer, monkeypatch):
    monkeypatch.setattr(t, "CACHE_PIECES", 10)
    encoder = t.Encoder(t.tokenizer_path())
    for k in range(4):
        texts = [" ".join(f"w{i + 9 * k}" for i in range(30))]
        ids, _ = encoder.encode(next(pieces(pa.array(texts))))
        assert ids.tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(t.tokenizer_path())


SPECIAL = ["<|endoftext|>", "<|endoftext|", "endoftext|>", "<", "a", "'s", " ", "  ", "\n", "é", "|", "1"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SPECIAL), max_size=12).map("".join), min_size=1, max_size=4))
def test_special_tokens_as_the_plain_tokenizer_has_them(plain, texts):
    encoder = t.Encoder.of(t.tokenizer_path(), True)
    for piece in pieces(pa.array(texts)):
        ids, counts = encoder.encode(piece)
        want = [plain.encode(x, add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


def test_query_and_stage_match_the_plain_tokenizer(spark, plain, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "x  <|endoftext|><|endoftext|> <|endoftext|>"), (3, "code<|endoftext|>\n"), (4, "<|endoftext"), (5, "|> none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (t.op10_token_files(spark, str(tmp_path)), t.tokens_stage(spark, df, str(tmp_path))):
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == brute(plain, rows)
    assert 50256 in plain.encode(rows[0][1], add_special_tokens=False).ids


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    texts = ["the cat sat on the mat", "a dog, a cat", "", "on the mat the dog"] * 3
    encoder = t.Encoder(t.tokenizer_path(), True)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    plain = t.range_hash
    for keep in (3, 30, (1 << 64) - 1):  # few names: unequal pieces share one, within a batch and with the cache
        monkeypatch.setattr(t, "range_hash", lambda *a, keep=keep: plain(*a) & np.uint64(keep))
        for n in (1, 2, len(texts)):
            ids, counts = encoder.encode(next(pieces(pa.array(texts[:n]))))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[:n]
        encoder.forget()


def test_rows_that_share_an_id_are_spread_and_in_order(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(5, f"other {i}") for i in range(300)] + [(9, "last")]
    got = t.tokens_of(spark.createDataFrame(rows, "doc_id long, text string"), special=True).collect()
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None] * 300 + [5] * 300 + [9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))


def test_a_worker_keeps_few_pieces_between_tasks_and_forgets_many(monkeypatch):
    e = t.Encoder(t.tokenizer_path(), True)
    first, second = (next(pieces(pa.array([x]))) for x in ("one two three", "two three four"))
    want = t.Encoder(t.tokenizer_path(), True).encode(second)
    e.encode(first)
    known = e.slots
    e.rest()
    assert e.slots == known > 0
    got = e.encode(second)
    assert e.slots < known + 3 and all((a == b).all() for a, b in zip(got, want, strict=True))
    monkeypatch.setattr(t, "KEEP_PIECES", 2)
    e.rest()
    assert e.slots == 0
