"""Rank correlations against pandas, matrices, and draws that move together."""

import datetime

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.arrays import LEVELS, Z
from tidemark.operators import copula


def months(n):
    return [datetime.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]


def panel(spark, values):
    rows = [("t", s, m, None if v is None else float(v)) for s, y in values.items() for m, v in zip(months(len(y)), y, strict=True)]
    return spark.createDataFrame(rows, "target string, series string, period date, y double")


def walks(seed=0, n=60):
    rng = np.random.default_rng(seed)
    shared = rng.normal(0, 0.1, n)
    return {s: np.exp(6 + np.cumsum(w * shared + rng.normal(0, 0.05, n))) for s, w in (("a", 1), ("b", 1), ("c", -1), ("d", 0))}


def test_correlations_match_a_plain_count(spark):
    values = {s: list(y) for s, y in walks().items()}
    values["b"][20:24] = [None, 0.0, -1.0, values["b"][24]]
    values["d"][5:9] = [100.0, 200.0, 400.0, 800.0]  # equal changes
    values["flat"] = [7.0] * 60
    values["short"] = [1.0, 2.0, 3.0]
    logs = pd.DataFrame({s: pd.Series(np.log(np.array([np.nan if v is None or v <= 0 else v for v in y], float))) for s, y in values.items()})
    ranks = logs.diff().round(9).rank()
    got = {(r.a, r.b): r for r in copula.correlations(copula.changes(panel(spark, values), ["target"]), ["target"]).collect()}
    assert len(got) == 15
    for (a, b), r in got.items():
        both = ranks[[a, b]].dropna()
        assert r.n == len(both)
        if "short" in (a, b) or "flat" in (a, b):
            assert r.rho is None and r.r == 0
        else:
            rho = np.corrcoef(both[a], both[b])[0, 1]
            assert r.rho == pytest.approx(rho) and r.r == pytest.approx(0.8 * 2 * np.sin(np.pi * rho / 6))
    assert got["a", "b"].r > 0.4 and got["a", "c"].r < -0.4


def test_matrices_are_correlations(spark):
    pairs = [("t", "a", "b", 0.9), ("t", "a", "c", 0.9), ("t", "b", "c", -0.9), ("u", "x", "y", 0.5)]
    df = spark.createDataFrame(pairs, "target string, a string, b string, r double")
    got = {(r.target, r.series): r for r in copula.matrices(df, ["target"]).collect()}
    m = np.array([got["t", s].row for s in "abc"])
    assert np.diag(m) == pytest.approx(np.ones(3)) and m == pytest.approx(m.T) and np.linalg.eigvalsh(m).min() > 0
    assert m[0, 1] > 0.3 > -0.3 > m[1, 2]
    assert got["u", "x"].row == pytest.approx([1, 0.5]) and got["u", "y"].names == ["x", "y"]


def test_draws_are_coupled_and_keep_their_margins(spark):
    q = lambda mid: [float(mid * np.exp(0.2 * z)) for z in Z]
    rows = [(1, "t", s, q(m)) for s, m in (("a", 100), ("b", 50), ("c", 10), ("new", 5))] + [(2, "t", "a", q(100)), (2, "t", "b", None)]
    f = spark.createDataFrame(rows, "origin int, target string, series string, q array<double>")
    matrix = copula.matrices(spark.createDataFrame([("t", "a", "b", 0.8), ("t", "a", "c", -0.6), ("t", "b", "c", -0.5)], "target string, a string, b string, r double"), ["target"])
    draw = lambda f, **k: {(r.origin, r.series): np.array(r.draws) for r in copula.coupled_draws(f, matrix, ["target"], ["origin", "target"], 4000, **k).collect()}
    got = draw(f)
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "new"), (2, "a")}
    r = np.corrcoef([np.log(got[1, s]) for s in ("a", "b", "c", "new")])
    assert np.abs(r - [[1, 0.8, -0.6, 0], [0.8, 1, -0.5, 0], [-0.6, -0.5, 1, 0], [0, 0, 0, 1]]).max() < 0.06
    for s, m in (("a", 100), ("b", 50), ("new", 5)):
        assert np.quantile(got[1, s], LEVELS[1:-1]) == pytest.approx(q(m)[1:-1], rel=0.05)
    again, other = draw(f.repartition(5)), draw(f, seed=1)
    assert all((again[k] == got[k]).all() and (other[k] != got[k]).any() for k in got)


def test_empty(spark):
    p = spark.createDataFrame([], "target string, series string, period date, y double")
    pairs = copula.correlations(copula.changes(p, ["target"]), ["target"])
    f = spark.createDataFrame([("t", "a", [float(i) for i in range(1, 10)])], "target string, series string, q array<double>")
    assert pairs.count() == 0 and copula.matrices(pairs, ["target"]).count() == 0
    assert len(copula.coupled_draws(f, copula.matrices(pairs, ["target"]), ["target"], ["target"], 50).first().draws) == 50
