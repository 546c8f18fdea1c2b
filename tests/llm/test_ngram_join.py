import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ngram_join as n
from tidemark.llm.components import components, joined

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def rows_of_corpus(seed):
    rnd = random.Random(seed)
    text = lambda k: [rnd.choice("the of a Zu é then on re".split()) + str(rnd.randint(0, 60)) for _ in range(k)]
    rows = []
    for i in range(25):
        base = text(rnd.randint(1, 70))
        for _ in range(rnd.choice([1, 1, 2, 4, 30 if i == 3 else 3])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                t[rnd.randrange(len(t))] = "edit" + str(rnd.randint(0, 9))
            rows.append((len(rows), rnd.choice([" ", "\n"]).join(t).upper() if rnd.random() < 0.3 else " ".join(t)))
    chain = text(60)
    for i in range(20):  # each step is a link, the ends are not
        chain = chain[1:] + text(1)
        rows.append((1000 - i, " ".join(chain)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two three"), (None, rows[0][1]), (None, "lonely null " * 3), (0, rows[0][1]), (5, rows[9][1]), (2006, " ".join(text(6000)))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("bucket", "block"), [(1, 2048), (1, 3), (12, 2048)])
def test_matches_brute_force(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(n, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(n, "LIST_BLOCK", block)
    rows = rows_of_corpus(bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in n.link_groups(df).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_a_hot_list_comes_to_no_task_whole(spark, monkeypatch):
    rnd = random.Random(7)
    share = [f"s{k}" for k in range(30)]
    rows = [(i, " ".join(share + [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([2, 3, 5, 8, 40]))])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(n, "LIST_BLOCK", 16)
    monkeypatch.setattr(n, "TASK_LIST", 20)
    seen = []
    plain = n.prefix_postings
    monkeypatch.setattr(n, "prefix_postings", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in n.link_groups(df).collect()]
    assert sorted(got, key=repr) == brute(rows)
    sent = Counter()
    for r in seen[0].collect():
        sent.update(n.unpack(r.grams, np.uint64, True).tolist())
    assert max(sent.values()) <= 3 * n.TASK_LIST  # three tasks


@pytest.mark.parametrize("edits", [3, 5, 7])
def test_near_misses_of_one_passage(spark, edits, monkeypatch):
    """Copies with random edits, most of them no link of each other: few pairs reach the second round."""
    rnd = random.Random(edits)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(120):
        t = list(base)
        for k in rnd.sample(range(200), edits):
            t[k] = f"e{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(t)))
    seen = []
    plain = n.second_pairs
    monkeypatch.setattr(n, "second_pairs", lambda *a: seen.append(n.cut(plain(*a))) or seen[-1])
    monkeypatch.setattr(n, "LIST_BLOCK", 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in n.link_groups(df).collect()), key=repr) == brute(rows)
    assert sum(x.count() for x in seen) < 1000  # of 7,140


@pytest.mark.parametrize("n_grams", [1, 200, 255, 257, 3000, 40_000])
def test_parity_bounds_the_difference(n_grams):
    rng = np.random.default_rng(n_grams)
    shape = n.Shape()
    a = rng.integers(0, 1 << 63, n_grams, dtype=np.uint64)
    for part in (0.0, 0.05, 0.3, 1.0):
        b = np.concatenate([a[int(part * n_grams) :], rng.integers(0, 1 << 63, int(part * n_grams) + n_grams // 9, dtype=np.uint64)])
        (pa_, pb) = n._parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        size = min(len(pa_), len(pb))
        x, y = n._folded(pa_, size), n._folded(pb, size)
        apart = int(np.bitwise_count(x ^ y).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        common = len(set(a.tolist()) & set(b.tolist()))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert n._may_link(x, y[None], np.int64(len(a)), np.array([len(b)]), shape).all()
    assert (n._folded(pa_, 128) == n._folded(n._folded(pa_, len(pa_)).tobytes(), 128)).all()


def test_hot_lists_are_last_at_every_size_of_sketch():
    """Counts over 65,535 keep their order, and the sketch grows with the text."""
    counts = np.array([1, 3, 300, 70_000, 5_000_000])
    rank = n._rank(counts)
    assert (np.diff(rank.astype(int)) > 0).all() and rank.max() < 256
    assert n.cell_bits(1 << 20) == 20 < n.cell_bits(1 << 29) and n.cell_bits(1 << 45) == n.CELL_BITS[1]


def test_empty_and_clashing_columns(spark):
    assert n.link_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 1, 2), (2, "a b c d e", 3, 4)], "doc_id long, text string, part int, class int")
    assert {r.component_id for r in n.link_groups(df).collect()} == {1}


def test_components_after_further_edges(spark):
    df = lambda e: spark.createDataFrame(e, "u long, v long")
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]
    more = [(3, 11), (21, 40), (50, 51), (41, 40), (31, 30)]
    got = {r.node: r.component for r in joined(components(df(first)), df(more)).collect()}
    assert got == {r.node: r.component for r in components(df(first + more)).collect()}
    assert {r.node: r.component for r in joined(components(df(first)), df(more).limit(0)).collect()} == {r.node: r.component for r in components(df(first)).collect()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and got[301] == 300


def stage_groups(rows):
    """Groups of row numbers linked at five words and 0.8."""
    words = [WORD.findall((t or "").lower()) for _, t, *_ in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_stage_matches_brute_force(spark):
    rnd = random.Random(5)
    text = lambda k: [f"v{rnd.randint(0, 5000)}" for _ in range(k)]
    rows = []
    for i in range(12):  # 10 to 30 edits in 1000 words lie on both sides of each threshold
        base = text(1000)
        near = list(base)
        for k in range(edits := 10 + 2 * i):
            near[20 + k * (960 // edits)] = f"edit{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (None, "null alone " * 5), (None, "null twice once"), (None, "NULL twice once")]
    rows += [(1, " ".join(text(40))), (1, " ".join(text(50))), (0, rows[0][1]), (0, rows[0][1]), (50, "same id here"), (50, "other words here"), (60, None), (60, ""), (61, " \n")]
    df = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    group = stage_groups(rows)
    assert len({group[2 * i] == group[2 * i + 1] for i in range(12)}) == 2 and group[24] == group[0] and group[12] == group[13]
    got = n.near_duplicate_stage(spark, df, "").collect()
    assert len(got) == len(set(group))
    text_group = {rows[i][1]: g for i, g in enumerate(group)}
    for g in set(group):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == g]
        left = [r.doc_id for r in got if text_group[r.text] == g]
        assert left == [min((d for d in ids if d is not None), default=None)]
