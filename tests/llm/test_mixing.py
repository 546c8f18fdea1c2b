import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{j}" for j in range(rnd.choice([0, 1, 30, 300, 900]))), "en", rnd.choice(["hot"] * 6 + ["a", "é", None, "z"]), 1) for i in range(300)]
    return rows + [(300, None, None, None, None), (301, "", "en", "only empty", 0), (5, rows[5][1], "en", rows[5][3], 1), (5, "other text", "en", rows[5][3], 1), (None, "null id words", "en", "a", 3), (302, "w " * 20000, "en", "long", 1)]


def test_targets_and_taken(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = m.document_totals(df).collect()
    assert len(got) == len(docs)
    sizes = defaultdict(int)
    for _, t, _, s, _ in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(sizes), Counter()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1, 2 * min(m.BLOCK, sizes[s] // m.FINENESS))
    assert sorted(map(repr, got)) == sorted(map(repr, m.document_totals(df.repartition(2)).collect()))


def test_sources_of_any_size_come_near_their_targets(spark):
    sizes = {f"s{n:03d}": n for n in [*range(1, 41), 64, 100, 128, 200, 255, 256, 600]}
    rows = [(i, " ".join("w" for _ in range(n)), "en", s, 1) for i, (s, n) in enumerate(sizes.items())]
    want = targets(sizes)
    for r in m.document_totals(spark.createDataFrame(rows, SCHEMA)).collect():
        assert abs(r.taken - want[r.source]) <= max(1, 2 * (sizes[r.source] // m.FINENESS)), r


def test_shards_draw_multinomial_counts(spark):
    plan = spark.createDataFrame([(1, 200_000), (2, 50_000), (3, 7), (4, 0)], "source_no long, slots long")
    counts = m.shard_counts(plan, 16).collect()
    by = {(r.source_no, r.shard): r["count"] for r in counts}
    assert {k[1] for k in by if k[0] == 1} == set(range(16))
    for no, n in ((1, 200_000), (2, 50_000), (3, 7)):
        mine = [by.get((no, k), 0) for k in range(16)]
        assert sum(mine) == n
        if no < 3:  # chi square of 15 degrees of freedom: neither off nor even
            assert 3 < sum((x - n / 16) ** 2 / (n / 16) for x in mine) < 45
    assert sorted(map(tuple, counts)) == sorted(map(tuple, m.shard_counts(plan.repartition(3), 16).collect()))


def test_slots_follow_the_counts(spark, docs):
    _, pieces, slots = m.mix(spark.createDataFrame(docs, SCHEMA))
    rows = slots.collect()
    for no in {r.source_no for r in rows}:
        mine = sorted((r.slot, r.shard) for r in rows if r.source_no == no)
        assert [s for s, _ in mine] == list(range(len(mine)))  # each slot once
        assert [k for _, k in mine] == sorted(k for _, k in mine)  # shard after shard
    assert len({r.shard for r in rows}) == m.LEAST_SHARDS


def test_stage_emits_the_words_taken(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    totals = Counter()
    for r in m.document_totals(df).collect():
        totals[r.doc_id] += r.taken
    words = Counter()
    for r in m.mixing_stage(spark, df, "").collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in totals.items() if v} == dict(words)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1001):
        got = [r[0] for r in spark.range(n).select(m._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9))).collect()]
        assert sorted(got) == list(range(n)) and (n < 7 or got != sorted(got))


def test_blocks_within_an_epoch_come_once(spark, docs):
    _, pieces, slots = m.mix(spark.createDataFrame(docs, SCHEMA))
    times = Counter((r.source_no, r.block) for r in slots.collect())
    assert max(times.values()) <= 2
    assert set(times) <= {(r.source_no, r.block) for r in pieces.collect()}


def test_empty_and_clashing_columns(spark):
    assert m.document_totals(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", 1, 2)], "doc_id long, text string, source string, size int, target int")
    assert m.document_totals(df).first().size == 2
