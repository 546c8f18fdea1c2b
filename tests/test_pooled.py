"""Pooled models: what the trees learn, that partitions do not matter, and bags against a plain count."""

import datetime

import numpy as np
import pytest

from tidemark.operators import models, pooled

SERIES, MONTHS = 8, 90


def values(seed):
    rng = np.random.default_rng(seed)
    t = np.arange(MONTHS)
    return 1000 * (1 + seed % 3) + 2 * t + 120 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 15, MONTHS)


def panel(spark, upto=84, short=False):
    rows = [("a", f"s{s}", datetime.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for s in range(SERIES) for i, v in enumerate(values(s)[:upto])]
    rows += [("a", "gap", r[2], None if 20 < i < 30 else 500.0) for i, r in enumerate(rows[:upto])]
    rows += [("few", "x", r[2], 5.0) for r in rows[60:70]] if short else []
    return spark.createDataFrame(rows, "target string, series string, period date, y double")


@pytest.mark.parametrize("model", ["boosted", "ensemble"])
def test_pooled_forecasts_follow_season_and_level(spark, model):
    full = {f"s{s}": values(s) for s in range(SERIES)}
    got = models.forecast(panel(spark, short=True), model, ["target"]).collect()
    assert {(r.target, r.series, r.horizon) for r in got} == {("a", s, h) for s in [*full, "gap"] for h in range(1, 7)}
    assert all(len(r.q) == 9 and r.q == sorted(r.q) and r.q[0] >= 0 for r in got)
    errors = [abs(r.q[4] - full[r.series][83 + r.horizon]) / full[r.series].mean() for r in got if r.series in full]
    assert np.mean(errors) < 0.06
    assert np.mean([r.q[0] <= full[r.series][83 + r.horizon] <= r.q[-1] for r in got if r.series in full]) > 0.7


def test_trees_do_not_depend_on_partitions(spark):
    one = sorted(map(repr, pooled.boosted_quantiles(panel(spark).coalesce(1), ["target"], rounds=4).collect()))
    many = sorted(map(repr, pooled.boosted_quantiles(panel(spark).repartition(7), ["target"], rounds=4).collect()))
    assert one == many


def test_rounds_lower_the_loss(spark):
    rows = pooled._binned(pooled.training_rows(panel(spark), ["target"], (1,)).withColumn("pool", pooled.pool_key(["target"]))).where("y is not null").persist()
    taus = [0.1, 0.5, 0.9]

    def loss(rounds):
        made = pooled.predicted(rows, pooled.fit(rows, pooled.Members(taus), rounds), ["y"]).collect()
        gap = np.array([[r.y - q for q in r.q] for r in made])
        return np.maximum(np.array(taus) * gap, (np.array(taus) - 1) * gap).mean()

    losses = [loss(k) for k in (0, 3, 12)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.8 * losses[0]


def test_first_split_is_that_of_a_plain_search(spark):
    rows = pooled._binned(pooled.training_rows(panel(spark), ["target"], (2,)).withColumn("pool", pooled.pool_key(["target"]))).where("y is not null").persist()
    (trees,) = pooled.fit(rows, pooled.Members([0.3]), 1).values()
    data = rows.select("y", "bins").collect()
    y, bins = np.array([r.y for r in data]), np.array([list(r.bins) for r in data])
    below, best = y < trees.start[0], None
    for f in range(pooled.FEATURES):
        for b in range(pooled.BINS + 1):
            left = bins[:, f] <= b
            if left.sum() >= pooled.LEAST and (~left).sum() >= pooled.LEAST:
                gain = sum((0.3 * s.sum() - (below & s).sum()) ** 2 / s.sum() for s in (left, ~left))
                best = (gain, -f, -b) if best is None else max(best, (gain, -f, -b))
    feature, edge, low, high = trees.rounds[0]
    assert (feature[0], edge[0]) == (-best[1], -best[2])
    left = bins[:, feature[0]] <= edge[0]
    for side, value in ((left, low[0]), (~left, high[0])):
        rest = y[side] - trees.start[0]
        assert np.mean(rest < value) <= 0.3 + 1e-9 and np.mean(rest <= value) >= 0.3 - 1e-9


def test_bags_and_weights():
    drawn = pooled.multiplicities(20, 7, 0)
    assert (drawn.sum(1) == 7).all() and (drawn == pooled.multiplicities(20, 7, 0)).all() and (drawn != pooled.multiplicities(20, 7, 1)).any()
    assert 0.2 < (drawn == 0).mean() < 0.5  # a block is out of about a third of the bags
    weights = pooled.Members([0.5] * 20, drawn).weights(np.array([0, 11, 12, 83, 500]))
    assert (weights == drawn[:, [0, 0, 1, 6, 6]].T).all()


def test_rows_of_training(spark):
    rows = {(r.series, r.horizon, r.age): r for r in pooled.training_rows(panel(spark), ["target"]).collect()}
    v = np.log1p(values(2)[:84])
    for h, t in ((1, 50), (6, 30), (3, 83)):
        r = rows["s2", h, 83 - t - h]
        level = v[t - 11 : t + 1].mean()
        assert r.level == pytest.approx(level) and r.x[:5] == pytest.approx([v[t - k] - level for k in pooled.LAGS])
        assert r.x[5] == pytest.approx(v[t + h - 12] - level) and r.x[6] == pytest.approx(level - v[t - 23 : t - 11].mean())
        assert r.y is None if t + h > 83 else r.y == pytest.approx(v[t + h] - level)
