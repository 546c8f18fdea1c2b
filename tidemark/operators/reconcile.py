"""Hierarchical reconciliation: minimum trace with a shrunk covariance, and coherence gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.session import ship

ERROR_ORIGINS = 36
REST = "~rest"


def shrink_covariance(errors: np.ndarray, fallback: np.ndarray, least: int = 3) -> np.ndarray:
    """Sample covariance with correlations shrunk towards none; missing errors are NaN.

    A node with fewer than `least` errors has the fallback variance. Eigenvalues are kept above
    a billionth of the largest.
    """
    seen = ~np.isnan(errors)
    n = seen.sum(0)
    mean = np.where(n > 0, np.nansum(errors, 0) / np.maximum(n, 1), 0)
    var = np.where(n >= least, np.where(seen, (errors - mean) ** 2, 0).sum(0) / np.maximum(n - 1, 1), fallback)
    var = np.maximum(var, 1e-12)
    if len(errors) < 3:
        return np.diag(var)
    z = np.where(seen, (errors - mean) / np.sqrt(var), 0.0)
    m = len(z)
    r = z.T @ z / m
    spread = ((z**2).T @ z**2 / m - r**2) / (m - 1)  # variance of the products of which r is the mean
    off = ~np.eye(len(var), dtype=bool)
    lam = np.clip(spread[off].sum() / max((r[off] ** 2).sum(), 1e-300), 0, 1)
    r = np.where(off, (1 - lam) * r, 1.0)
    w = r * np.sqrt(np.outer(var, var))
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    return (vectors * np.maximum(values, 1e-9 * values.max())) @ vectors.T


def project(y: np.ndarray, s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Generalised least squares onto coherent forecasts, of one vector or of several columns at once;
    nodes without a forecast are NaN (in every column)."""
    known = ~np.isnan(y.reshape(len(y), -1)).any(1)
    sk, wi = s[known], np.linalg.pinv(w[np.ix_(known, known)])
    return s @ np.linalg.solve(sk.T @ wi @ sk, sk.T @ wi @ y[known])


def reconcile(forecasts: DataFrame, errors: DataFrame, parents: dict[str, tuple[str, ...]], groups: list[str]) -> DataFrame:
    """Reconcile the quantiles of each group (target, horizon, origin).

    forecasts: groups, series, q. errors: groups, series, made, e (history of median errors), of which
    the ERROR_ORIGINS latest origins count. parents names each aggregate's bottom series; every other
    series is a bottom one. An aggregate with bottom series that have no forecast gets a node of its
    own below it for these, REST, without forecast and error, so that it is reconciled too and what
    its known series do not explain is the rest's. A group is one hierarchy, of as many rows as it
    has nodes; it returns a row for each series that came.
    """
    ship(forecasts.sparkSession)
    kinds = dict(forecasts.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in groups), "series string, q array<double>"])

    def run(f: pa.Table, e: pa.Table) -> pa.Table:
        names = sorted(f["series"].to_pylist())
        if not names:
            return pa.table({c: [] for c in [*groups, "series", "q"]}).cast(f.select([*groups, "series", "q"]).schema)
        q = dict(zip(f["series"].to_pylist(), f["q"].to_pylist(), strict=True))
        bottom = [s for s in names if s not in parents]
        rest = {f"{s}{REST}": s for s in names if s in parents and not set(parents[s]) <= set(bottom)}
        nodes, leaves = [*names, *rest], [*bottom, *rest]
        s = np.array([[float(b == v or b in parents.get(v, ()) or rest.get(b) == v) for b in leaves] for v in nodes])
        made = sorted(set(e["made"].to_pylist()))[-ERROR_ORIGINS:] if e.num_rows else []
        hist = np.full((len(made), len(nodes)), np.nan)
        at, row = {v: i for i, v in enumerate(nodes)}, {m: i for i, m in enumerate(made)}
        for m, v, x in zip(*(e[c].to_pylist() for c in ("made", "series", "e")), strict=True) if e.num_rows else ():
            if v in at and x is not None and m in row:
                hist[row[m], at[v]] = x
        y = np.array([q.get(v, [np.nan] * len(A.LEVELS)) for v in nodes], float)
        median = np.maximum(np.nan_to_num(y[:, A.MEDIAN]), 1)
        w = shrink_covariance(hist, 0.01 * median**2) if len(made) else np.diag(0.01 * median**2)
        out = np.maximum(np.sort(project(y, s, w), 1), 0)
        kept = {v: out[i].tolist() for i, v in enumerate(nodes)}
        cols = {g: pa.array([f[g][0].as_py()] * len(names), f.schema.field(g).type) for g in groups}
        return pa.table({**cols, "series": pa.array(names), "q": pa.array([kept.get(v, q[v]) for v in names], pa.list_(pa.float64()))})

    history = errors.select(*(F.col(c).alias(c) for c in (*groups, "series", "made", "e")))  # columns of its own, where both sides come from one table
    return forecasts.select(*groups, "series", "q").groupBy(*groups).cogroup(history.groupBy(*groups)).applyInArrow(run, schema)


def coherence_gaps(forecasts: DataFrame, parents: DataFrame, level: str, keys: list[str]) -> DataFrame:
    """Share by which a parent's median departs from the sum of its children's medians."""
    med = forecasts.select(*keys, "level", "series", A.at("q", 0.5).alias("m"))
    sums = med.where("level = 'org'").join(parents.select(F.col("org_code").alias("series"), F.col(level).alias("_p")), "series").groupBy(*keys, "_p").agg(F.sum("m").alias("child"), F.count("*").alias("children"))
    top = med.where(F.col("level") == level).select(*keys, F.col("series").alias("_p"), "m")
    gap = F.when(F.col("m") > 0, F.abs(F.col("m") - F.col("child")) / F.col("m"))
    return top.join(sums, [*keys, "_p"]).select(*keys, F.col("_p").alias("series"), "m", "child", "children", gap.alias("gap"))
