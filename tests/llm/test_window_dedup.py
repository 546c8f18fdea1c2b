import hashlib
import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import window_dedup as w

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(x[i : i + 35]) for _, x in texts for i in range(len(x) - 34))
    out = []
    for d, x in texts:
        gone = set()
        for i in range(len(x) - 34):
            if seen[tuple(x[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        left = " ".join(v for i, v in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: [rnd.choice("alpha beta é gamma Delta x y z 1 2 3".split()) + str(rnd.randint(0, 99)) for _ in range(n)]
    share = [text(34), text(35), text(60)]
    rows = []
    for i in range(60):
        t = text(rnd.randint(0, 90))
        if i % 2:
            k = rnd.randint(0, len(t))
            t[k:k] = rnd.choice(share)
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(t)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "a " * 400), (104, " ".join(text(5000))), (7, rows[8][1]), (7, rows[7][1]), (None, rows[9][1]), (None, "z " * 36), (105, " ".join(f"u{i}" for i in range(40)))]
    rows += [(200 + i, rows[11][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in w.dedup_windows(df).collect()), key=repr) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert w.dedup_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, part int, doc string")
    assert w.dedup_windows(df).first().n_words == 2


def test_rows_that_share_an_id_or_have_none(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    texts = [text(40) for _ in range(300)]
    rows = [(None, t) for t in texts] + [(None, f"first {t}") for t in texts[:150]] + [(7, f"{t} x") for t in texts[150:200]] + [(7, text(41)) for _ in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in w.dedup_windows(df).collect()), key=repr) == brute(rows)


def test_sketch_never_counts_too_few_and_few_too_many():
    code = np.arange(1, 20001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = code[:5000]
    shape = w.Sketch(1 << 17, 65)
    sent: dict[int, list] = {}
    for part in (code[:9000], code[9000:], twice):  # three tasks
        for p, cells, counts in shape.slices_of(part):
            sent.setdefault(p, []).append((cells, counts))
    bits = shape.whole({p: shape.merged(p, iter(x)) for p, x in sent.items()})
    got = shape.repeated(code, bits)
    assert got[:5000].all()
    one_row = [((bits[(c := shape.cells(code[5000:], r).astype(np.int64)) >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1).mean() for r in range(w.ROWS)]
    assert got[5000:].mean() < 0.1 and got[5000:].mean() < min(one_row)
