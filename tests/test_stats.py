"""Bootstraps, calibration, reconciliation and hashes against plain numpy versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.operators import calibrate as C
from tidemark.operators import quality, reconcile, score, stats
from tidemark.operators import vintage as V


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def test_paired_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.gamma(2, 50, (9, 5)), rng.gamma(2, 45, (9, 5))
    rows = lambda x: [("t", f"s{j}", month(i), float(x[i, j])) for i in range(9) for j in range(5)]
    df = lambda x: spark.createDataFrame(rows(x), "target string, series string, origin date, wis double").repartition(3)
    got = stats.paired_bootstrap(df(a), df(b), ["target", "series", "origin"], "origin", ["target"], n=500).first()
    x, y = a.mean(1), b.mean(1)
    idx = np.random.default_rng(0).integers(0, 9, (500, 9))
    diff, rel = (y - x)[idx].mean(1), y[idx].mean(1) / x[idx].mean(1) - 1
    assert got.diff == pytest.approx((y - x).mean()) and got.rel == pytest.approx(y.mean() / x.mean() - 1)
    assert (got.diff_lo, got.diff_hi) == pytest.approx(tuple(np.percentile(diff, [2.5, 97.5])))
    assert (got.rel_lo, got.rel_hi) == pytest.approx(tuple(np.percentile(rel, [2.5, 97.5])))


@pytest.mark.parametrize("units", [2, 8])
def test_two_way_share_equals_numpy(spark, units):
    rng = np.random.default_rng(7)
    hit = rng.random((6, units)) < 0.8
    rows = [(f"s{i}", month(j), 1, bool(hit[i, j])) for i in range(6) for j in range(units)]
    df = spark.createDataFrame(rows, "series string, origin date, horizon int, cov90 boolean").repartition(3)
    got = stats.two_way_share(df, ["horizon"], "series", "origin", "cov90", n=300).first()
    v, w = stats.unit_weights(units, 300, 0, 3), np.vstack([m for _, m in stats.series_weights(6, 300, 0)])
    within = (w @ hit).sum(1) / (w @ np.ones_like(hit, float)).sum(1)
    v = v if units >= 3 else np.ones_like(v)
    top, den = ((w @ hit) * v).sum(1), ((w @ np.ones_like(hit, float)) * v).sum(1)
    assert got.share == pytest.approx(hit.mean())
    assert (got.lo, got.hi) == pytest.approx(tuple(np.percentile(top / den, [2.5, 97.5])))
    assert (got.lo_within, got.hi_within) == pytest.approx(tuple(np.percentile(within, [2.5, 97.5])))


def test_two_way_difference_equals_numpy(spark):
    rng = np.random.default_rng(5)
    hit = rng.random((2, 6, 8)) < 0.7
    hit[1] |= rng.random((6, 8)) < 0.3
    df = lambda k: spark.createDataFrame([(f"s{i}", month(j), 1, bool(hit[k, i, j])) for i in range(6) for j in range(8)], "series string, origin date, horizon int, cov90 boolean").repartition(2)
    got = stats.two_way_difference(df(0), df(1), ["horizon"], "series", "origin", "cov90", n=200).first()
    v, w = stats.unit_weights(8, 200, 0, 3), np.vstack([m for _, m in stats.series_weights(6, 200, 0)])
    share = lambda x: ((w @ x) * v).sum(1) / ((w @ np.ones_like(x, float)) * v).sum(1)
    assert got.diff == pytest.approx(hit[1].mean() - hit[0].mean())
    assert (got.lo, got.hi) == pytest.approx(tuple(np.percentile(share(hit[1]) - share(hit[0]), [2.5, 97.5])))


def test_joint_bootstrap_draws_the_same_units_for_all_targets(spark):
    rng = np.random.default_rng(6)
    a, b = rng.gamma(2, 50, (2, 3, 9)), rng.gamma(2, 45, (2, 3, 9))
    df = lambda x: spark.createDataFrame([(f"t{t}", f"s{i}", month(j), float(x[t, i, j])) for t in range(2) for i in range(3) for j in range(9)], "target string, series string, origin date, wis double")
    got = {r.target: r for r in stats.joint_bootstrap(df(a), df(b), ["target", "series", "origin"], "origin", "target", n=300).collect()}
    x, y = a.mean(1), b.mean(1)
    idx = np.random.default_rng(0).integers(0, 9, (300, 9))
    drawn = y[:, idx].mean(2) / x[:, idx].mean(2)
    assert got["t1"].rel == pytest.approx(y[1].mean() / x[1].mean() - 1)
    both = np.sqrt(drawn[0] * drawn[1]) - 1
    assert (got[None].lo, got[None].hi) == pytest.approx(tuple(np.percentile(both, [2.5, 97.5]))) and got[None].units == 9


def toy_forecasts(spark, n_origins=20, n_series=3, seed=1):
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    for s in range(n_series):
        for o in range(n_origins):
            q = np.sort(rng.gamma(5, 20, 9))
            rows.append(("t", f"s{s}", month(o), 1, month(o), [float(x) for x in q], False))
            truth.append(("t", f"s{s}", month(o), float(rng.gamma(5, 20)), month(o + 1)))
    f = spark.createDataFrame(rows, "target string, series string, origin date, horizon int, period date, q array<double>, failed boolean")
    return rows, truth, f, spark.createDataFrame(truth, "target string, series string, period date, y_first double, resolved date")


def test_pooled_and_series_widths_equal_numpy(spark):
    rows, truth, f, t = toy_forecasts(spark)
    origins = spark.createDataFrame([(month(i),) for i in range(20)], "origin date")
    scores = C.conformity(f, t, ["target", "series", "period"])
    pooled = C.pooled_widths(scores, origins, ["target"])
    own = C.series_widths(scores, pooled, ["target"])
    y = {(r[1], r[2]): r[3] for r in truth}
    s = {}
    for _, name, o, _, p, q, _ in rows:
        x, v = np.log1p(q), np.log1p(y[name, p])
        s[name, o] = [max(x[i] - v, v - x[8 - i]) for i in range(4)]
    for r in pooled.collect():
        made = sorted({o for _, o in s if (o.year * 12 + o.month + 1) <= r.origin.year * 12 + r.origin.month}, reverse=True)[:12]
        pool = np.array([v for (_, o), v in s.items() if o in made])
        want = [np.quantile(pool[:, i], min(1, (1 - a) * (1 + 1 / len(pool)))) for i, a in enumerate(C.ALPHAS)]
        assert r.n == len(pool) and list(r.e) == pytest.approx(want)
    by = {r.origin: r.e for r in pooled.collect()}
    for r in own.collect():
        mine = np.array([v for (name, o), v in sorted(s.items(), key=lambda k: k[0][1], reverse=True) if name == r.series and (o.year * 12 + o.month + 1) <= r.origin.year * 12 + r.origin.month][:36])
        n = len(mine)
        for i, a in enumerate(C.ALPHAS):
            e = by[r.origin][i]
            if n >= np.ceil(1 / a):
                e = (n * np.quantile(mine[:, i], min(1, (1 - a) * (1 + 1 / n))) + 12 * e) / (n + 12)
            assert r.e[i] == pytest.approx(e)


def test_widening_moves_bounds_and_spares_failed(spark):
    _, _, f, _ = toy_forecasts(spark, 2, 1)
    w = spark.createDataFrame([("t", month(0), 1, [0.1, 0.2, 0.0, -0.05])], "target string, origin date, horizon int, e array<double>")
    before = {r.origin: r.q for r in f.collect()}
    got = {r.origin: r.q for r in C.apply_widths(f, w, ["target", "origin", "horizon"]).collect()}
    x = np.log1p(before[month(0)])
    e = np.array([0.1, 0.2, 0.0, -0.05])
    want = np.maximum(np.sort(np.expm1(np.concatenate([x[:4] - e, x[4:5], x[5:] + e[::-1]]))), 0)
    assert got[month(0)] == pytest.approx(list(want)) and got[month(1)] == before[month(1)]
    failed = C.apply_widths(f.withColumn("failed", F.lit(True)), w, ["target", "origin", "horizon"]).collect()
    assert all(r.q == before[r.origin] for r in failed)


def test_array_scores_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [([float(v) for v in np.sort(rng.normal(100, 30, 9))], float(rng.normal(100, 40))) for _ in range(40)] + [([5.0] * 9, 5.0), ([5.0] * 9, 4.0)]
    df = spark.createDataFrame(rows, "q array<double>, y double")
    got = df.select("q", "y", A.wis("q", "y").alias("w"), A.wis_from_intervals("q", "y").alias("w2"), A.pit("q", "y").alias("p"), A.crossed("q").alias("x")).collect()
    lv = np.array(A.LEVELS)
    for r in got:
        q = np.array(r.q)
        want = 2 * np.mean(np.where(r.y >= q, lv * (r.y - q), (lv - 1) * (r.y - q)))
        assert r.w == pytest.approx(want) and r.w2 == pytest.approx(want) and not r.x
        if len(set(r.q)) == 9:
            assert r.p == pytest.approx(float(np.interp(r.y, q, lv, 0, 1)))


def test_reconciled_groups_add_up(spark):
    rng = np.random.default_rng(2)
    rows, errors = [], []
    for h in (1, 2):
        for name, k in (("P", 3.2), ("a", 1.0), ("b", 2.0)):
            rows.append(("t", h, name, [float(k * 100 + 10 * i) for i in range(9)]))
            errors += [("t", h, name, month(j), float(rng.normal(0, 10))) for j in range(12)]
    f = spark.createDataFrame(rows, "target string, horizon int, series string, q array<double>")
    e = spark.createDataFrame(errors, "target string, horizon int, series string, made date, e double")
    out = {(r.horizon, r.series): np.array(r.q) for r in reconcile.reconcile(f, e, {"P": ("a", "b")}, ["target", "horizon"]).collect()}
    assert len(out) == 6
    for h in (1, 2):
        assert out[h, "P"] == pytest.approx(out[h, "a"] + out[h, "b"])


def test_guards_and_hashes(spark):
    df = spark.createDataFrame([(month(0), month(1), 1, "m"), (month(2), month(3), 2, "m")], "origin date, period date, v int, model string")
    assert quality.require_unsealed(df).count() == 2
    late = df.withColumn("origin", F.lit("2024-05-01").cast("date"))
    with pytest.raises(PermissionError):
        quality.require_unsealed(late)
    assert quality.require_unsealed(late, token="x").count() == 2
    with pytest.raises(ValueError, match="more than one v"):
        quality.require_one_slice(df, ["v"], ["origin"])
    with pytest.raises(ValueError, match="keys repeat"):
        quality.require_one_slice(df.union(df), ["model"], ["origin"])
    with pytest.raises(ValueError, match="repeats keys"):
        quality.many_to_one(df, df.union(df), ["origin"])
    h = quality.row_hash(df).first().hash
    assert quality.row_hash(df.repartition(2, "v")).first().hash == h != quality.row_hash(df.limit(1)).first().hash


def test_grid_equals_a_join_with_every_origin(spark):
    from tidemark.functions.calendar import second_thursday
    from tidemark.plans import testbed as T

    v, o = T.vintages(spark, "/root/testdata/sf0.001"), T.months(spark, "1999-01-01", "1999-12-01")
    seen = v.crossJoin(o).where((F.col("snapshot") <= second_thursday("origin")) & (F.col("period") <= F.add_months("origin", -1)))
    want = seen.groupBy("origin", *V.KEY).agg(F.max_by("value", "version").alias("value"))
    got = sorted(map(repr, V.as_of_grid(v, o).collect()))
    assert got == sorted(map(repr, want.collect())) and got


def test_chains_that_do_not_end_have_no_end(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(100, 101), (101, 100), (200, 201), (200, 202), (300, 300)]
    df = spark.createDataFrame(edges, "predecessor long, successor long")
    got = {r.code: r.final for r in quality.follow(spark, df, 8).collect()}
    assert got == {i: 12 if 12 - i <= 8 else None for i in range(1, 12)} | {100: None, 101: None}


def test_an_aggregate_with_an_absent_child_is_reconciled_with_a_rest(spark):
    rng = np.random.default_rng(2)
    rows = [("t", n, [float(k * 100 + 10 * i) for i in range(9)]) for n, k in (("P", 5.0), ("Q", 3.2), ("a", 1.0), ("b", 2.0))]
    errors = [("t", n, month(j), float(rng.normal(0, 10))) for n, *_ in (("P",), ("Q",), ("a",), ("b",)) for j in range(40)]
    f = spark.createDataFrame(rows, "target string, series string, q array<double>")
    e = spark.createDataFrame(errors, "target string, series string, made date, e double")
    parents = {"P": ("a", "gone"), "Q": ("a", "b")}
    out = {r.series: np.array(r.q) for r in reconcile.reconcile(f, e, parents, ["target"]).collect()}
    assert set(out) == {"P", "Q", "a", "b"} and out["Q"] == pytest.approx(out["a"] + out["b"])
    assert out["P"] == pytest.approx(np.array(rows[0][2]))  # the rest takes what its known child does not explain
    old = [(t, s, d.replace(year=d.year - 50), x * 1000) for t, s, d, x in errors]
    again = reconcile.reconcile(f, spark.createDataFrame(errors + old, e.schema), parents, ["target"]).collect()
    assert {r.series: r.q for r in again} == {s: pytest.approx(q.tolist()) for s, q in out.items()}  # older errors do not count


def test_newest_null_wins_and_reuploads_go(spark):
    v = spark.createDataFrame([(month(0), "o", "m", 1, 5.0, month(1)), (month(0), "o", "m", 2, None, month(2))], "period date, org_code string, metric string, version int, value double, snapshot date")
    assert V.latest(v).first().value is None and V.as_of(v, "2000-02-15").first().value == 5.0
    q = spark.createDataFrame([("q", "a", month(0), 1.0), ("q", "a", month(1), 1.0), ("q", "a", month(2), 2.0), ("q", "a", month(3), 1.0)], "quarter string, org string, published date, x double")
    kept = V.drop_reuploads(q, ["quarter"], ["org"], ["x"])
    assert sorted(r.published for r in kept.collect()) == [month(0), month(2), month(3)]


def test_drop_order_of_scores(spark):
    f = spark.createDataFrame([("a", month(0), [1.0] * 9, 0.0), ("b", month(0), None, 1.0), ("c", month(0), [1.0] * 9, 1.0), ("d", month(0), [1.0] * 9, None)], "series string, period date, q array<double>, scale double")
    t = spark.createDataFrame([("a", month(0), 1.0), ("b", month(0), 1.0), ("d", month(0), 2.0)], "series string, period date, y double")
    rows, counts = score.score(f, t, ["series", "period"])
    assert tuple(counts.first()) == (1, 1, 1, 1)
    r = rows.first()
    assert r.series == "d" and r.mase is None


def test_adaptive_levels_by_series_match_a_plain_loop(spark):
    """Series go their own ways through pools that they share; late resolutions, gaps and ties included."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tidemark.operators import calibrate as C

    rng = np.random.default_rng(3)
    month = lambda k: dt.date(2000 + k // 12, k % 12 + 1, 1)
    rows = []
    for o in range(40):
        for s in range(7):
            if rng.random() < 0.9:
                x = np.round(np.abs(rng.normal(0.1 * s, 0.3)) + rng.normal(0, 0.1, 4), 2)
                rows.append((month(o), month(o + int(rng.integers(1, 4))), "t", 3, f"s{s}", x.tolist()))
    df = spark.createDataFrame(rows, "origin date, resolved date, target string, horizon int, series string, s array<double>")
    origins = spark.createDataFrame([(month(o),) for o in range(40)], "origin date")
    pools = C.ranked_pools(df, origins, ["target"])
    got = {(r.origin, r.series): r for r in C.adaptive_widths(C.adaptive_levels(df, pools, origins, ["target"], bucket=2), pools, ["target"]).collect()}

    names = sorted({r[4] for r in rows})
    k, span, gamma = 8, 60, 0.001 * 2.0 ** np.arange(8)
    issued = {}
    for i, a in enumerate(C.ALPHAS):
        alpha, w, past = {s: np.full(k, a) for s in names}, {s: np.ones(k) for s in names}, []
        for t in range(40):
            known = [r for r in rows if r[1] <= month(t)]
            for before in sorted({r[0] for r in known if r[1] == month(t)}):
                pool = issued.get((i, before))
                if pool is None:
                    continue
                step = {}
                past.append(step)
                for _, _, _, _, s, x in (r for r in known if r[0] == before and r[1] == month(t)):
                    beta = 1 - np.interp(x[i], pool, np.linspace(0, 1, len(pool)))
                    p = w[s] / w[s].sum()
                    loss = a * (beta - alpha[s]) - np.minimum(0, beta - alpha[s])
                    step[s] = (p * loss**2).sum()
                    total = sum(q.get(s, 0) for q in past[-span:])
                    eta = np.sqrt((np.log(k * span) + 2) / total) if total > 0 else 0
                    v = w[s] * np.exp(-eta * (loss - loss.min()))
                    v = (1 - 1 / (2 * span)) * v + v.sum() / (2 * span) / k
                    w[s], alpha[s] = v / v.sum(), alpha[s] + gamma * (a - (alpha[s] > beta))
            latest = sorted({r[0] for r in known})[-C.POOL_ORIGINS :]
            pool = sorted(r[5][i] for r in known if r[0] in latest)
            if len(pool) < C.POOL_LEAST:
                continue
            issued[i, month(t)] = np.array(pool)
            for s in names:
                if (month(t), s) in got:
                    level = np.clip(1 - (w[s] * alpha[s]).sum() / w[s].sum(), 0, 1)
                    assert abs(got[month(t), s].levels[i] - level) < 1e-9
                    assert abs(got[month(t), s].e[i] - np.quantile(pool, level)) < 1e-9
    assert len(got) > 200


def test_normal_quantiles_and_uniforms(spark):
    from statistics import NormalDist

    u = [1e-6, 0.001, 0.02, 0.02425, 0.3, 0.5, 0.7, 0.9757, 0.99, 1 - 1e-6]
    got = [r.z for r in spark.createDataFrame([(x,) for x in u], "u double").select(A.normal_quantile(F.col("u")).alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in u], abs=1e-7)
    draws = lambda parts: spark.range(4000, numPartitions=parts).select("id", A.uniform(F.lit("k"), F.col("id")).alias("a"), A.uniform(F.lit("k"), F.col("id"), 1).alias("b")).orderBy("id").collect()
    one = draws(1)
    assert one == draws(9)
    a, b = np.array([r.a for r in one]), np.array([r.b for r in one])
    assert 0 < a.min() and a.max() < 1 and abs(a.mean() - 0.5) < 0.02 and abs(a.var() - 1 / 12) < 0.005 and abs(np.corrcoef(a, b)[0, 1]) < 0.05


def test_occupied_beds_spread_as_admissions_and_coefficients_do(spark):
    from tidemark.operators import decide as D

    q = [float(np.exp(5 + 0.2 * z)) for z in A.Z]
    f = spark.createDataFrame([("x", 7, q, 30)], "series string, org_code long, q array<double>, days int")
    coefs = spark.createDataFrame([(7, 1.5, 0.1)], "org_code long, log_c double, s double")
    logs = np.log(np.array(D.occupied_draws(f, coefs, ["series"], draws=4000).first().draws))
    assert logs.mean() == pytest.approx(5 + 1.5 - np.log(30), abs=0.02) and logs.std() == pytest.approx(np.hypot(0.2, 0.1), abs=0.01)
    assert np.allclose(logs, np.log(np.array(D.occupied_draws(f.repartition(5), coefs, ["series"], draws=4000).first().draws)))


def test_least_squares_equals_lstsq(spark):
    from tidemark.operators import seasonal as S

    rng = np.random.default_rng(5)
    rows = [(g, dt.date(2000 + i // 12, i % 12 + 1, 1), None if i == 7 else float(rng.normal(3, 1) + (i % 12) * 0.1)) for g, n in (("a", 61), ("b", 24), ("short", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, period date, y double").repartition(3)
    for x in ([F.lit(1.0), *S.fourier("period", 6)], [F.lit(1.0), *S.month_contrasts("period")], [F.lit(1.0)]):
        got = {r.g: r for r in S.least_squares(df, ["g"], x, F.col("y")).collect()}
        values = df.where("y is not null").select("g", F.array(*(c.cast("double") for c in x)).alias("x"), "y").collect()
        for g in ("a", "b", "short"):
            a, y = np.array([r.x for r in values if r.g == g]), np.array([r.y for r in values if r.g == g])
            want = np.linalg.lstsq(a, y, rcond=None)[0]
            assert got[g].n == len(y) and np.allclose(got[g].b, want, atol=1e-6) and got[g].sse == pytest.approx(((y - a @ want) ** 2).sum(), abs=1e-6)
    december = [r.x for r in df.where(F.month("period") == 12).select(F.array(*S.month_contrasts("period")).alias("x")).collect()]
    assert all(x == [-1.0] * 11 for x in december)
