import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            marked |= set(range(i, i + 5))
    n, r = len(words), len(marked)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 10 or 100 * r > 20 * n


TEXTS = [None, "", " \n\t ", "é ü x ß", "a b c d e " * 6, "one\ntwo\none\n\none", "x# y$ *&|<>" * 3, "\n".join(f"line {i} with words" for i in range(12)), "same words here\n" * 4 + " ".join(f"w{i}" for i in range(60)), "long" * 50000 + " tail", " ".join(f"w{i}" for i in range(40)) * 2]


def test_statistics_match_brute_force(spark):
    rows = [(i, t, None, None if i % 3 else f"s{i % 2}", None) for i, t in enumerate(TEXTS)] * 2
    got = q.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_host_verdict_spares_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(30))
    odd = " ".join(f"w{i}###" for i in range(30))
    rows = [(i, odd, None, "bad", None) for i in range(90)] + [(100 + i, clean, None, "bad", None) for i in range(10)]
    rows += [(200 + i, clean, None, f"good{i % 5}", None) for i in range(200)] + [(500, odd, None, "good0", None)]
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert not any(got[i] for i in range(90))
    assert all(got[i] for i in [*range(100, 110), *range(200, 400), 500])


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert q.judge(docs, ["doc_id"]).count() == 0
    extra = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("_text", F.lit(2))
    assert q.judge(extra, ["doc_id"]).first().n_words == 2


@pytest.mark.parametrize("limit", [0, 10])
def test_join_beyond_the_broadcast_limit(spark, limit):
    from tidemark.llm.joins import join_side

    left = spark.createDataFrame([(i, None if i % 4 == 0 else "k") for i in range(40)], "i int, key string")
    right = spark.createDataFrame([(None, 1), ("k", 2)], "key string, v int")
    got = join_side(left, right, "key", F.col("i"), limit).collect()
    assert len(got) == 40 and all(r.v == (1 if r.key is None else 2) for r in got)
