import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import suffix_dedup as s


def brute(rows):
    out, first = [], {}
    key = lambda d: -(1 << 62) if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, key(d)), key(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [tuple(r) for r in s.dedup_substrings(df).collect()]


def check(spark, rows):
    order = lambda x: sorted(x, key=repr)
    assert order(run(spark, rows)) == order(brute(rows))


def test_copies_passages_and_edges(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rnd.randint(5, 80)) for _ in range(40)]
    share = [text(15), text(9), "x" * 49, "y" * 50, "z" * 51]
    rows = list(enumerate(base))
    for i in range(60):
        t = rnd.choice(base)
        k = rnd.randint(0, len(t))
        rows.append((100 + i, rnd.choice([t, t[:k] + rnd.choice("qrs") + t[k + 1 :], t[k:], text(5) + rnd.choice(share) + text(4), rnd.choice(share) * 3])))
    rows += [(300, None), (301, ""), (302, "short"), (303, "a" * 400), (304, "a" * 300), (305, "ab" * 120), (306, "ab" * 90 + "c"), (None, share[0] + "!" * 60), (None, "!" * 55), (5, base[7]), (5, base[5]), (5, base[5]), (307, text(4000)), (308, base[3] + text(3000) + base[4])]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert s.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a" * 60, 3, "x"), (2, "a" * 55, 4, "y")], "doc_id long, text string, part int, doc string")
    assert sorted((r.doc_id, r.n_removed) for r in s.dedup_substrings(df).collect()) == [(1, 0), (2, 55)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 4), min_size=60, max_size=60))
def test_refinement_keeps_sorted_pointers(first, later):
    first = np.array(first)
    keys = np.array(later[: len(first)])
    pointer = np.searchsorted(np.sort(first), first)
    got = s.refine(pointer, keys.astype(np.uint64))
    pairs = list(zip(first.tolist(), keys.tolist()))
    assert got.tolist() == [sum(q < p for q in pairs) for p in pairs]


def test_keys_of_refinement_are_bucket_pointers(monkeypatch):
    rnd = np.random.default_rng(4)
    sides = rnd.integers(97, 99, (400, s.SIDE)).astype(np.uint8)
    sides[200:] = sides[:200]
    sides[200:300, 20:] = 0
    bucket = np.repeat(np.arange(0, 400, 50), 50)
    seen, plain = [], s.refine

    def spy(pointer, later):
        out = plain(pointer, later)
        seen.append((later.copy(), out.copy()))
        return out

    monkeypatch.setattr(s, "refine", spy)
    order, place, lcp = s.depth_names(bucket, sides)
    # each round sorts on places in the order of suffixes; each but the first, on what the last one wrote
    assert all(k.max() < 4 * len(sides) for k, _ in seen)
    assert all((k == before).all() for (k, _), (_, before) in zip(seen[1:], seen))
    keys = [(b, t.tobytes()) for b, t in zip(bucket.tolist(), sides)]
    assert [keys[i] for i in order] == sorted(keys)
    for i in range(1, 400):
        a, b = keys[order[i - 1]], keys[order[i]]
        same = next((k for k in range(s.SIDE) if a[1][k] != b[1][k]), s.SIDE)
        assert lcp[i] == (same if a[0] == b[0] else -1)


def test_a_passage_in_all_documents_gives_no_large_bucket(spark):
    share = "this sentence stands in every document of the table, word for word, from its start to its end. "
    rnd = random.Random(2)
    rows = [(i, f"{rnd.random()} {share} {rnd.random()}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = s.with_doc_part(df, 65)
    sent = [len(s.unpack(r.grams, np.uint64, True)) for r in s.initial_buckets(docs, 65).collect()]
    assert max(sent) < 400  # of each task two documents a q-gram, the rest goes straight on
    check(spark, rows)


def test_rows_that_share_an_id_are_dealt_over_parts(spark):
    rows = [(None, f"{i} " * 30) for i in range(500)] + [(64 * i, f"{i} " * 30) for i in range(500)]
    dealt = s.with_doc_part(spark.createDataFrame(rows, "doc_id long, text string"), 65).groupBy("part").count().collect()
    assert max(r["count"] for r in dealt) < 40
    check(spark, rows[:60] + rows[500:560])
