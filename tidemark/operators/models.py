"""Forecast models as grouped-map functions; the grid of series and origins is Spark's.

A model takes the monthly values of one series and returns nine quantiles for each horizon. Missing months are null; a model that cannot
be fitted returns no row for that series.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.arrays import LEVELS, Z
from tidemark.operators import pooled
from tidemark.session import ship

HORIZONS = 6
SEASON = 12
PATHS = 1000
MIN_OBS = 30
NEAR = 60


def fill(y: np.ndarray) -> np.ndarray | None:
    """Leading gaps cut, inner ones interpolated; None if too short or the last month is missing."""
    ok = ~np.isnan(y)
    if ok.sum() < MIN_OBS or not ok[-1]:
        return None
    y = y[np.argmax(ok) :]
    t = np.arange(len(y))
    ok = ~np.isnan(y)
    return np.interp(t, t[ok], y[ok])


def _aicc(sse: float, n: int, k: int) -> float:
    return n * np.log(max(sse, 1e-12) / n) + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)


def _smooth(y: np.ndarray, p: np.ndarray, multiplicative: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Run exponential smoothing for many parameter rows (alpha, beta, gamma, phi) at once."""
    k = len(p)
    first, second = y[:SEASON].mean(), y[SEASON : 2 * SEASON].mean()
    level, trend = np.full(k, first), np.full(k, (second - first) / SEASON)
    season = np.tile(y[:SEASON] / first if multiplicative else y[:SEASON] - first, (k, 1))
    a, b, g, phi = p.T
    trend = np.where(b > 0, trend, 0.0)
    errors = np.empty((k, len(y)))
    for t, v in enumerate(y):
        s = season[:, t % SEASON]
        base = level + phi * trend
        made = base * s if multiplicative else base + s
        e = v - made
        errors[:, t] = e / np.maximum(np.abs(made), 1e-9) if multiplicative else e
        up = e / np.maximum(np.abs(s), 1e-9) if multiplicative else e
        level = base + a * up
        trend = phi * trend + b * up
        season[:, t % SEASON] = s + g * (e / np.maximum(np.abs(base), 1e-9) if multiplicative else e)
    return errors, level, trend, season


def ets(y: np.ndarray, seed: int, known: dict | None = None) -> np.ndarray | None:
    """Seasonal exponential smoothing: additive or multiplicative, with or without damped trend;
    parameters by a seeded search, the model by AICc, quantiles from simulated paths.

    known: parameters of the fits of an earlier origin, around which a short search begins; those of this fit
    take their place.
    """
    y = fill(y)
    if y is None or len(y) < 2 * SEASON + 6:
        return None
    rng = np.random.default_rng(seed)
    best = None
    for mult in (False, True):
        if mult and (y <= 0).any():
            continue
        for damped in (False, True):
            width = np.array([0.1, 0.05 * damped, 0.05, 0.03 * damped])
            low, high = [0.005, 0, 0, 0.8 if damped else 1], [0.99, 0.5 * damped, 0.6, 0.98 if damped else 1]
            start = None if known is None else known.get((mult, damped))
            if start is None:
                p = np.column_stack([rng.uniform(0.01, 0.9, 200), rng.uniform(0.001, 0.3, 200) * damped, rng.uniform(0.001, 0.4, 200), rng.uniform(0.8, 0.98, 200) if damped else np.ones(200)])
            else:
                p = np.clip(start + np.vstack([np.zeros(4), rng.normal(0, 1, (NEAR, 4))]) * width, low, high)
            mine = None
            for _ in range(2 if start is None else 1):
                errors, *state = _smooth(y, p, mult)
                raw = errors * (np.abs(y) if mult else 1.0)
                sse = np.nansum(raw[:, SEASON:] ** 2, 1)
                i = int(np.nanargmin(sse))
                score = _aicc(sse[i], len(y) - SEASON, 4 + 2 * damped)
                if mine is None or score < mine[0]:
                    mine = (score, p[i])
                if best is None or score < best[0]:
                    best = (score, mult, p[i], errors[i, SEASON:], [s[i] for s in state])
                p = np.clip(p[i] + rng.normal(0, 1, p.shape) * width, low, high)
            if known is not None:
                known[mult, damped] = mine[1]
    _, mult, (a, b, g, phi), errors, (level, trend, season) = best
    sd = errors.std(ddof=1)
    level, trend = np.full(PATHS, level), np.full(PATHS, trend)
    season = np.tile(season, (PATHS, 1))
    out = np.empty((HORIZONS, PATHS))
    for h in range(HORIZONS):
        j = (len(y) + h) % SEASON
        base, s = level + phi * trend, season[:, j].copy()
        made = base * s if mult else base + s
        e = rng.normal(0, sd, PATHS) * (made if mult else 1.0)
        out[h] = made + e
        up = e / np.maximum(np.abs(s), 1e-9) if mult else e
        level, trend = base + a * up, phi * trend + b * up
        season[:, j] = s + g * (e / np.maximum(np.abs(base), 1e-9) if mult else e)
    return np.maximum(np.quantile(out, LEVELS, axis=1).T, 0)


def loess(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Local linear fits with tricube weights over the `span` nearest points."""
    span = min(span, len(x))
    d = np.abs(at[:, None] - x[None, :])
    reach = np.sort(d, 1)[:, span - 1 : span] + 1e-9
    k = np.clip(1 - (d / reach) ** 3, 0, 1) ** 3 * w
    sw = np.maximum(k.sum(1), 1e-12)
    mx, my = (k * x).sum(1) / sw, (k * y).sum(1) / sw
    dx = x[None, :] - mx[:, None]
    slope = (k * dx * (y[None, :] - my[:, None])).sum(1) / np.maximum((k * dx * dx).sum(1), 1e-12)
    return my + slope * (at - mx)


def decompose(y: np.ndarray, span: int = 25, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Robust seasonal-trend decomposition by local regression: (seasonal, trend)."""
    n, half = len(y), SEASON // 2
    t, w, trend, seasonal = np.arange(n, dtype=float), np.ones(n), np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        for _ in range(2):
            detrended = y - trend
            for m in range(SEASON):
                i = np.arange(m, n, SEASON)
                seasonal[i] = loess(t[i], detrended[i], w[i], t[i], span)
            kernel = np.ones(SEASON + 1) / SEASON
            kernel[[0, -1]] /= 2
            low = np.convolve(np.concatenate([seasonal[half:SEASON], seasonal, seasonal[n - SEASON : n - half]]), kernel, "valid")
            seasonal = seasonal - low
            trend = loess(t, y - seasonal, w, t, 2 * SEASON - 1)
        r = np.abs(y - trend - seasonal)
        w = np.clip(1 - (r / max(6 * np.median(r), 1e-9)) ** 2, 0, 1) ** 2
    return seasonal, trend


def _arma(d: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Conditional errors of ARMA(1, 1) for many parameters at once."""
    e = np.zeros((len(phi), len(d)))
    for t in range(len(d)):
        e[:, t] = d[t] - (phi * d[t - 1] + theta * e[:, t - 1] if t else 0)
    return e


def stl_arima(y: np.ndarray, seed: int, known: dict | None = None) -> np.ndarray | None:
    """Seasonally adjusted ARIMA of four small orders by AICc, with Gaussian quantiles. Parameters lie on a grid
    that is gone through whole, so fits of earlier origins are of no use to it."""
    y = fill(y)
    if y is None:
        return None
    seasonal, _ = decompose(y)
    d = np.diff(y - seasonal)
    grid = np.linspace(-0.95, 0.95, 39)
    best = None
    for ar, ma in ((0, 1), (1, 0), (1, 1), (0, 0)):
        phi, theta = (g.ravel() for g in np.meshgrid(grid if ar else [0.0], grid if ma else [0.0]))
        e = _arma(d, phi, theta)
        sse = (e[:, 1:] ** 2).sum(1)
        i = int(sse.argmin())
        score = _aicc(sse[i], len(d) - 1, 1 + ar + ma)
        if best is None or score < best[0]:
            best = (score, phi[i], theta[i], e[i], sse[i] / max(len(d) - 1 - ar - ma, 1))
    _, phi, theta, e, s2 = best
    level, step = (y - seasonal)[-1], phi * d[-1] + theta * e[-1]
    weights, psi, out, var = [1.0], phi + theta, [], 0.0
    for h in range(HORIZONS):
        level += step
        step *= phi
        var += s2 * sum(weights) ** 2 if h else s2
        out.append((level + seasonal[len(y) - SEASON + h % SEASON], np.sqrt(var)))
        weights.append(psi * phi**h)
    return np.array([[max(m + z * s, 0.0) for z in Z] for m, s in out])


LOCAL: dict[str, Callable] = {"ets": ets, "stl_arima": stl_arima}
POOLED: dict[str, Callable] = {"boosted": pooled.boosted_quantiles, "ensemble": pooled.bootstrap_ensemble}


def forecast(panel: DataFrame, model: str, by: list[str]) -> DataFrame:
    """Forecasts of a spine-joined panel: by, series, horizon, q.

    Local models get one series a group; pooled ones are fitted by `pooled`, where no task holds a panel.
    """
    if model in POOLED:
        return POOLED[model](panel, by)
    ship(panel.sparkSession)
    fit = LOCAL[model]
    kinds = dict(panel.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "series string, horizon int, q array<double>"])

    def run(table: pa.Table) -> pa.Table:
        names = sorted(set(table["series"].to_pylist()))
        months = table["period"].to_pylist()
        first = min(months)
        k = [(m.year - first.year) * 12 + m.month - first.month for m in months]
        wide = np.full((len(names), max(k) + 1), np.nan)
        at = {s: i for i, s in enumerate(names)}
        for s, j, v in zip(table["series"].to_pylist(), k, table["y"].to_pylist(), strict=True):
            wide[at[s], j] = np.nan if v is None else v
        seed = zlib.crc32("|".join([*(str(table[b][0].as_py()) for b in by), *names]).encode())
        one = fit(wide[0], seed)
        got = None if one is None else one[None]
        rows = [] if got is None else [(s, h + 1, got[i, h].tolist()) for i, s in enumerate(names) for h in range(HORIZONS) if not np.isnan(got[i, h]).any()]
        cols = {b: pa.array([table[b][0].as_py()] * len(rows), table.schema.field(b).type) for b in by}
        return pa.table({**cols, "series": pa.array([r[0] for r in rows], pa.string()), "horizon": pa.array([r[1] for r in rows], pa.int32()), "q": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})

    return panel.select(*by, "series", "period", "y").groupBy(*by, "series").applyInArrow(run, schema)


def rolling(panels: DataFrame, model: str, by: list[str]) -> DataFrame:
    """Forecasts of a local model at every origin: by, origin, series, horizon, q.

    panels (by, origin, series, period, y) are as each origin saw them. A task gets a series once, with all its
    origins in order, and a fit begins where that of the origin before ended; one group is a series' history
    times its origins (a few thousand numbers), whatever the number of series.
    """
    ship(panels.sparkSession)
    fit = LOCAL[model]
    kinds = dict(panels.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"origin {kinds['origin']}, series string, horizon int, q array<double>"])

    def run(table: pa.Table) -> pa.Table:
        name = table["series"][0].as_py()
        label = "|".join([*(str(table[b][0].as_py()) for b in by), name])
        origins, months = table["origin"].to_pylist(), table["period"].to_pylist()
        at: dict = {}
        for o, m, v in zip(origins, months, table["y"].to_pylist(), strict=True):
            at.setdefault(o, {})[m.year * 12 + m.month] = np.nan if v is None else v
        known: dict = {}
        rows = []
        for o in sorted(at):
            first, last = min(at[o]), max(at[o])
            y = np.array([at[o].get(k, np.nan) for k in range(first, last + 1)])
            got = fit(y, zlib.crc32(f"{label}|{o}".encode()), known)
            if got is not None:
                rows += [(o, h + 1, q.tolist()) for h, q in enumerate(got) if not np.isnan(q).any()]
        keys = {b: pa.array([table[b][0].as_py()] * len(rows), table.schema.field(b).type) for b in by}
        return pa.table({**keys, "origin": pa.array([r[0] for r in rows], table.schema.field("origin").type), "series": pa.array([name] * len(rows), pa.string()), "horizon": pa.array([r[1] for r in rows], pa.int32()), "q": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})

    return panels.select(*by, "origin", "series", "period", "y").groupBy(*by, "series").applyInArrow(run, schema)
