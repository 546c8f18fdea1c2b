import numpy as np
import pandas as pd

from tidemark.operators.calibrate import Experts
from tidemark.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_daily_stream_equals_batch(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    got = {(str(r.day), r.event_type): r.n for r in S.run_once(S.daily(S.read_table(spark, SF, "events"))).collect()}
    want = {(str(r.day), r.event_type): r["count"] for r in batch.selectExpr("cast(ts as date) day", "event_type").groupBy("day", "event_type").count().collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 2 * len({k[1] for k in want})  # the last days wait for the watermark


def test_sessions_and_dedupe(spark):
    rows = S.run_once(S.sessions(S.read_table(spark, SF, "events"))).collect()
    assert rows and all(r.end > r.start for r in rows)
    n = S.run_once(S.new_versions(S.read_table(spark, SF, "events"), ["event_id"])).count()
    assert n == spark.read.parquet(f"{SF}/events.parquet").select("event_id").distinct().count()


def test_adaptive_levels_keep_a_bounded_state(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.normal(0, 40, 60))] + [("b", i, 0.5) for i in range(60)]
    for k in range(2):
        pd.DataFrame([r for r in rows if r[1] // 30 == k], columns=["key", "seq", "s"]).to_parquet(tmp_path / f"{k}.parquet")
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("key string, seq long, s double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
        got = S.run_once(S.adaptive_levels(stream, "key"), "update").collect()
    finally:
        spark.conf.unset(store)
    for key in ("a", "b"):
        expert, pool, want = Experts(0.1), [], []
        for i, s in enumerate(s for k, _, s in rows if k == key):
            if pool:
                expert.update(np.array([1 - np.mean([p <= s for p in pool])]), np.array([0]), i + 1)
            pool.append(s)
            if i % 30 == 29:
                want.append(expert.level()[0])
        levels = [r.level for r in got if r.key == key]
        assert len(levels) == 2 and np.allclose(sorted(levels), sorted(want), atol=0.05)


def test_histogram_ranks():
    rng = np.random.default_rng(1)
    counts, edges, seen = np.zeros(S.POOL_CELLS), np.linspace(-1.0, 1.0, S.POOL_CELLS + 1), []
    for x in rng.standard_t(3, 3000) * 100:
        counts, edges = S._with_score(counts, edges, x)
        seen.append(x)
    assert counts.sum() == 3000 and len(counts) == S.POOL_CELLS
    cell = edges[1] - edges[0]
    for x in rng.standard_t(3, 50) * 100:
        low, high = (np.mean(np.array(seen) <= v) for v in (x - cell, x + cell))
        assert low - 1e-9 <= S._rank_of(counts, edges, x) <= high + 1e-9
