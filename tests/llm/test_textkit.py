import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packed, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\r 学\x0b.", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_and_pieces(texts, limit):
    got, rows = [], []
    for piece in textkit.pieces(pa.array(texts, pa.string()), limit):
        words = textkit.Words(piece)
        for i, row in enumerate(piece.rows):
            rows.append(int(row))
            lo, hi = words.first[i], words.first[i + 1]
            got.append([piece.data[a:b].tobytes().decode() for a, b in zip(words.starts[lo:hi], words.ends[lo:hi])])
            assert (words.doc[lo:hi] == i).all()
    assert rows == list(range(len(texts)))
    assert got == [WORD.findall(t or "") for t in texts]


def test_pieces_of_a_slice():
    arr = pa.array(["aa", "b", None, "cc d", ""])[1:4]
    p = list(textkit.pieces(arr))
    assert [int(r) for x in p for r in x.rows] == [0, 1, 2]
    assert b"".join(x.data.tobytes() for x in p) == b"bcc d"


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.data())
def test_equal_ranges_have_equal_hashes(data, draw):
    codes = textkit.BYTE_CODES[np.frombuffer(data, np.uint8)]
    n = len(data)
    pairs = [tuple(sorted(draw.draw(st.tuples(st.integers(0, n), st.integers(0, n))))) for _ in range(6)]
    a, b = (np.array(x) for x in zip(*pairs))
    h = textkit.range_hash(codes, a, b)
    for i in range(6):
        for j in range(6):
            assert (h[i] == h[j]) == (data[a[i] : b[i]] == data[a[j] : b[j]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_packing_round_trips(values):
    a = np.sort(np.array(values, np.uint64))
    assert (packed.unpack(packed.pack(a, True), np.uint64, True) == a).all()
    m = np.array(values, np.int64).view(np.uint8).reshape(-1, 8)
    assert (packed.unpack(packed.pack(m), np.uint8, width=8).reshape(m.shape) == m).all()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_parts_cover_and_agree(spark, parts):
    docs = spark.createDataFrame([(i * 3 - 40, "x") for i in range(50)] + [(None, "y"), (None, None), (5, "x"), (5, "x"), (5, "z")], "doc_id long, text string")
    rows = packed.with_doc_part(docs, parts).collect()
    assert all(r.part == r.key % parts and r.tag >= 0 for r in rows)  # as tasks deal what they know by key alone
    assert len({(r.part, r.key, r.tag) for r in rows if (r.doc_id, r.text) == (5, "x")}) == 1
    assert len({r.part for r in rows}) > min(parts, 30) // 2
    h = np.sort(textkit.mix(np.arange(1000, dtype=np.uint64)))
    p = packed.hash_part(h, parts)
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() < parts


def test_windows_and_coverage():
    first = np.array([0, 3, 3, 8])
    at, doc = textkit.windows(first, 3)
    assert at.tolist() == [0, 3, 4, 5] and doc.tolist() == [0, 2, 2, 2]
    assert textkit.covered(np.array([1, 2]), 2, 6).tolist() == [False, True, True, True, False, False]
    assert not textkit.covered(np.zeros(0, np.int64), 2, 0).size
