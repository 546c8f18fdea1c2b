import random
import re

import numpy as np

from tidemark.llm import decontaminate as d

rnd = random.Random(8)
VOCAB = "the of and a in to with was".split() + [f"w{i}" for i in range(300)]


def sentence(k):
    return " ".join(rnd.choice(VOCAB) for _ in range(k)).capitalize() + "."


ITEMS = [(i, " ".join(sentence(rnd.randint(5, 14)) for _ in range(rnd.randint(1, 6)))) for i in range(30)] + [(90, None), (91, ""), (92, "...")]


def brute(doc, item):
    """Share of the item's five-word runs in the whole document."""
    words = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
    a, b = words(item), words(doc)
    runs = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
    there = {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
    return len(runs & there) / len(runs) if runs else 0.0


def test_planted_items_are_found_and_clean_documents_left(spark, monkeypatch):
    rows, planted = [], {}
    for i in range(120):
        text = [sentence(rnd.randint(5, 20)) for _ in range(rnd.randint(1, 40))]
        if i % 3 == 0:
            item, words = rnd.choice(ITEMS[:30])
            text.insert(rnd.randint(0, len(text)), words)
            planted[i] = item
        rows.append((i, rnd.choice([" ", "\n"]).join(text)))
    rows += [(200, None), (201, ""), (202, ITEMS[0][1].upper().replace(" ", "  ")), (203, "x " * 30000 + ITEMS[1][1]), (0, rows[0][1])]
    planted |= {202: 0, 203: 1}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (1000, 7):
        monkeypatch.setattr(d, "INDEX_ITEMS", limit)
        got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
        want = {(i, j) for i, t in rows for j, w in ITEMS[:30] if brute(t, w) >= d.SHARE}
        assert set(planted.items()) <= got == want


def test_block_maxima_lose_no_passage(spark):
    index = next(d.build_indexes(spark.createDataFrame(ITEMS[:30], "item_id long, text string")))
    text = " ".join(sentence(12) for _ in range(60)) + " " + " ".join(w for _, w in ITEMS[:5])
    codes = d._word_codes(text)

    class One:
        first, counts, doc = np.array([0, len(codes)]), np.array([len(codes)]), np.zeros(len(codes), np.int64)

    got = {(e, w) for _, e, _, w in d._search(index, One, codes)}
    want = set()
    for start in range(0, len(codes), d.ENTRY):
        own = np.unique(codes[start : start + 2 * d.ENTRY])
        t = np.searchsorted(index.terms, own)
        t = t[index.terms[np.minimum(t, len(index.terms) - 1)] == own] if len(t) else t
        score = np.zeros(len(index.own))
        for x in t:
            at = slice(index.first[x * d.BLOCKS], index.first[(x + 1) * d.BLOCKS])
            score[index.entry[at]] += index.impact[at]
        want |= {(int(e), start) for e in np.flatnonzero(score >= d.THRESHOLD)}
    assert want and got == want


def test_blocks_and_entries_below_the_threshold_are_not_scored(spark):
    r = random.Random(6)
    own = lambda i, k: " ".join(f"i{i}w{r.randint(0, 40)}" for _ in range(k))
    items = [(i, f"{own(i, 12)} the of and. {own(i, 8)}") for i in range(128)]
    index = next(d.build_indexes(spark.createDataFrame(items, "item_id long, text string")))

    class One:
        def __init__(self, codes):
            self.first, self.counts, self.doc = np.array([0, len(codes)]), np.array([len(codes)]), np.zeros(len(codes), np.int64)

    text = d._word_codes(items[5][1])
    assert {int(index.owner[e]) for _, e, _, _ in d._search(index, One(text), text)} == {5}
    assert index.scored <= 2  # of 128: the words that all items hold make none a candidate
    common = d._word_codes("the of and " * 200)
    assert not list(d._search(index, One(common), common)) and index.scored <= 2


def test_indexes_of_one_reading_give_what_single_ones_give(spark, monkeypatch):
    docs = spark.createDataFrame([(i, sentence(20) + " " + w + " " + sentence(9)) for i, w in ITEMS[:30]], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, d.contaminated(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(d, "INDEX_ITEMS", 5)
    for scan in (1, 3, 100):
        monkeypatch.setattr(d, "SCAN_INDEXES", scan)
        assert sorted(map(tuple, d.contaminated(docs, items).select("doc_id", "item_id").collect())) == want


def test_empty_tables_and_clashing_columns(spark):
    items = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEMS[0][1], 5, "x")], "doc_id long, text string, item_id int, hits string")
    assert d.contaminated(docs, none).count() == 0
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert [(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()] == [(1, 0)]


def test_items_that_share_an_id_or_have_none(spark, monkeypatch):
    items = [(7, sentence(20)), (7, sentence(20)), (7, sentence(20)), (None, sentence(20)), (None, sentence(20)), (8, sentence(20))]
    docs = [(k, sentence(15) + " " + text + " " + sentence(15)) for k, (_, text) in enumerate(items)] + [(90, sentence(60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (1000, 2):
        monkeypatch.setattr(d, "INDEX_ITEMS", limit)
        got = [(r.doc_id, r.item_id) for r in d.contaminated(df, spark.createDataFrame([*items, items[0]], "item_id long, text string")).collect()]
        assert sorted(got) == [(k, item_id) for k, (item_id, _) in enumerate(items)]


def test_edited_items_are_found_and_clean_documents_left(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randint(0, 3000)}" if r.random() < 0.6 else r.choice("the of and a in to with was".split())
    some = lambda k: [word() for _ in range(k)]
    items, rows, planted = [], [], set()
    for i, size in enumerate([30, 37, 45, 37, 45, 60, 30, 37, 45]):
        question, answer = some(size - 12), some(12)
        items.append((i, " ".join(question) + ". " + " ".join(answer)))
        words = question + answer
        for k, at in enumerate(((size - 12) // 2, size - 6, 5)[: 1 + i % 3]):
            words[at] = f"edit{k}"
        rows.append((i, " ".join(some(50) + words + some(50))))
        planted.add((i, i))
        rows.append((100 + i, " ".join(some(200) + r.sample(question + answer, size) + some(50))))  # its words, shuffled
        rows.append((200 + i, " ".join(some(50) + question + some(50))))  # no answer
        rows.append((300 + i, " ".join(some(300))))
    items.append((50, "rare1 rare2. rare3"))
    rows += [(400, "rare1 x rare2 y rare3"), (401, "so rare1 rare2 rare3")]
    got = {(x.doc_id, x.item_id) for x in d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == planted | {(401, 50)}
    assert sum(brute(rows[4 * i][1], items[i][1]) < d.SHARE for i in range(9)) >= 5
