import numpy as np
import pytest

from tidemark.operators import models as M
from tidemark.operators.calibrate import Experts
from tidemark.operators.reconcile import project, shrink_covariance
from tidemark.operators import stats


def series(n=84, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 1000 + 2 * t + 120 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 15, n)


@pytest.mark.parametrize("fit", [M.ets, M.stl_arima])
def test_local_models_follow_a_seasonal_trend(fit):
    y = series(90)
    q = fit(y[:84], 1)
    assert q.shape == (6, 9) and (np.diff(q, axis=1) >= 0).all() and (q >= 0).all()
    assert np.abs(q[:, 4] - y[84:]).mean() < 60
    assert ((y[84:] >= q[:, 0] - 30) & (y[84:] <= q[:, -1] + 30)).all()


@pytest.mark.parametrize("model", ["ets", "stl_arima"])
def test_rolling_fits_see_each_origin_alone(spark, model):
    import datetime

    y = series(90)
    day = lambda i: datetime.date(2000 + i // 12, i % 12 + 1, 1)
    rows = [("a", s, day(o), day(i), float(y[i] * k + (5 if i == o - 1 else 0))) for s, k in (("x", 1), ("z", 3)) for o in (70, 74, 78, 84) for i in range(o)]
    rows += [("a", "short", day(84), day(i), 1.0) for i in range(70, 84)]
    panels = spark.createDataFrame(rows, "target string, series string, origin date, period date, y double")
    got = M.rolling(panels, model, ["target"]).collect()
    assert {(r.series, r.origin, r.horizon) for r in got} == {(s, day(o), h) for s in "xz" for o in (70, 74, 78, 84) for h in range(1, 7)}
    assert sorted(map(repr, got)) == sorted(map(repr, M.rolling(panels.repartition(5), model, ["target"]).collect()))
    of = {(r.series, r.origin, r.horizon): r.q for r in got}
    gaps = [abs(of["x", day(o), h][4] - y[o + h - 1]) for o in (70, 74, 78, 84) for h in range(1, 7)]
    assert np.mean(gaps) < 60 and all(sorted(q) == q and q[0] >= 0 for q in of.values())
    # what later origins know changes nothing before them
    early = M.rolling(panels.where(f"origin <= '{day(74)}'"), model, ["target"]).collect()
    assert all(of[r.series, r.origin, r.horizon] == r.q for r in early)


def test_fits_near_known_ones_are_as_good():
    y = series(84)
    known: dict = {}
    M.ets(y[:80], 1, known)
    assert set(known) == {(m, d) for m in (False, True) for d in (False, True)}
    near, whole = M.ets(y, 2, known), M.ets(y, 2)
    assert np.abs(near[:, 4] - whole[:, 4]).max() < 25


def test_local_models_refuse_what_they_cannot_fit():
    y = series()
    y[-1] = np.nan
    assert M.ets(y, 0) is None and M.stl_arima(y, 0) is None and M.ets(y[:20], 0) is None


def test_decomposition_adds_up_to_a_seasonal_pattern():
    y = series()
    s, t = M.decompose(y)
    assert np.abs(y - s - t).mean() < 25 and np.abs(s).max() > 80


def test_models_run_as_grouped_maps(spark):
    import datetime

    rows = [("a", f"s{s}", datetime.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for s in range(3) for i, v in enumerate(series(72, s))]
    panel = spark.createDataFrame(rows, "target string, series string, period date, y double")
    for model in ("ets", "stl_arima"):
        got = M.forecast(panel, model, ["target"]).collect()
        assert len(got) == 18 and all(len(r.q) == 9 for r in got)
        assert sorted(map(repr, got)) == sorted(map(repr, M.forecast(panel.repartition(3), model, ["target"]).collect()))


def test_projection_is_coherent_and_keeps_coherent_forecasts():
    s = np.array([[1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    w = shrink_covariance(np.random.default_rng(0).normal(size=(20, 4)), np.ones(4))
    out = project(np.array([10.0, 2, 3, 4]), s, w)
    assert out[0] == pytest.approx(out[1:].sum())
    same = s @ np.array([2.0, 3, 4])
    assert project(same, s, w) == pytest.approx(same)
    assert project(np.array([9.0, np.nan, 3, 4]), s, w)[1] == pytest.approx(2)
    assert np.linalg.eigvalsh(w).min() > 0


def test_covariance_falls_back_for_short_histories():
    e = np.array([[1.0, np.nan], [2.0, np.nan], [4.0, 1.0]])
    w = shrink_covariance(e, np.array([9.0, 9.0]))
    assert w[1, 1] == pytest.approx(9.0) and w[0, 0] == pytest.approx(np.var([1, 2, 4], ddof=1))


def test_two_way_weights_draw_series_then_blocks(monkeypatch):
    v, w = stats.unit_weights(7, 50, 1, 3), np.vstack([m for _, m in stats.series_weights(5, 50, 1)])
    assert (w.sum(1) == 5).all() and (v.sum(1) == 7).all()
    monkeypatch.setattr(stats, "CHUNK", 35)  # seven replicates at a time: the same draws
    parts = list(stats.series_weights(5, 50, 1))
    assert [at for at, _ in parts] == list(range(0, 50, 7)) and (np.vstack([m for _, m in parts]) == w).all()


def test_covariance_equals_the_array_of_products():
    rng = np.random.default_rng(8)
    e = rng.normal(0, 1, (12, 6)) @ rng.normal(0, 1, (6, 6))
    w, var = shrink_covariance(e, np.ones(6)), e.var(0, ddof=1)
    z = (e - e.mean(0)) / np.sqrt(var)
    prod = z[:, :, None] * z[:, None, :]
    r, off = prod.mean(0), ~np.eye(6, dtype=bool)
    lam = np.clip((prod.var(0) / 11)[off].sum() / (r[off] ** 2).sum(), 0, 1)
    assert w == pytest.approx(np.where(off, (1 - lam) * r, 1) * np.sqrt(np.outer(var, var)))


def test_experts_widen_after_misses_and_narrow_after_hits():
    both, one = Experts(0.1, 2), np.array([0])
    for step in range(200):
        both.update(np.array([0.01, 0.9]), np.array([0, 1]), step)
    assert both.level()[0] > 0.9 > both.level()[1]
    alone = Experts(0.1, 1)
    for step in range(200):
        alone.update(np.array([0.01]), one, step)
    assert alone.level()[0] == both.level()[0]
