"""Bootstraps: paired over units, and two-way over series and blocks of origins.

Rows never meet replicates. They are first summed to counts a unit (or a series and unit); only
those counts are multiplied with replicate weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.score import paired
from tidemark.session import cut, ship


def paired_bootstrap(a: DataFrame, b: DataFrame, keys: list[str], unit: str, by: list[str], metric: str = "wis", n: int = 1000, seed: int = 0) -> DataFrame:
    """Mean difference and relative change with 95 % percentile intervals, for each `by`.

    Units are drawn with replacement in sorted order from one seeded generator a group.
    """
    ship(a.sparkSession)
    units = paired(a, b, keys, metric).groupBy(*by, unit).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    kinds = dict(units.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "diff double, diff_lo double, diff_hi double, rel double, rel_lo double, rel_hi double, units long"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(unit)
        x, y = table["a"].to_numpy(), table["b"].to_numpy()
        idx = np.random.default_rng(seed).integers(0, len(x), (n, len(x)))
        diff, rel = (y - x)[idx].mean(1), y[idx].mean(1) / x[idx].mean(1) - 1
        row = [(y - x).mean(), *np.percentile(diff, [2.5, 97.5]), y.mean() / x.mean() - 1, *np.percentile(rel, [2.5, 97.5])]
        names = ["diff", "diff_lo", "diff_hi", "rel", "rel_lo", "rel_hi"]
        return pa.table({**{c: table[c].slice(0, 1) for c in by}, **{k: pa.array([float(v)]) for k, v in zip(names, row, strict=True)}, "units": pa.array([len(x)], pa.int64())})

    return units.groupBy(*by).applyInArrow(run, schema)


CHUNK = 1 << 22


def unit_weights(n_units: int, n: int, seed: int, block: int) -> np.ndarray:
    """Multiplicities of units drawn in moving blocks (n x units)."""
    rng = np.random.default_rng([seed, 1])
    size = min(block, n_units)
    starts = rng.integers(0, n_units - size + 1, (n, -(-n_units // size)))
    slots = (starts[:, :, None] + np.arange(size)).reshape(n, -1)[:, :n_units]
    return np.stack([np.bincount(s, minlength=n_units) for s in slots])


def series_weights(n_series: int, n: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Multinomial multiplicities of series, some replicates at a time: the first of them, and a
    matrix (some x series). Every task draws the same ones."""
    rng = np.random.default_rng([seed, 0])
    step = max(1, CHUNK // max(n_series, 1))
    for at in range(0, n, step):
        picks = rng.integers(0, n_series, (min(step, n - at), n_series))
        yield at, np.stack([np.bincount(p, minlength=n_series) for p in picks])


def _numbered(counts: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of an axis of the design and their places in sorted order."""
    return counts.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)


def _two_way(rows: DataFrame, sides: dict[str, Column], cells: list[str], series: str, unit: str, finish: Callable[..., dict], outputs: str, n: int, seed: int, block: int) -> DataFrame:
    """Sums of `sides` by cell, series and unit, weighted by replicates, and what finish() makes of them.

    Rows are first summed; series and units are numbered in Spark and the weights drawn in the
    tasks, so neither goes through the driver. A cell is one group of at most series x units sums.
    """
    ship(rows.sparkSession)
    counts = cut(rows.groupBy(*cells, series, unit).agg(*(F.sum(c).alias(name) for name, c in sides.items())))
    of_series, of_units = cut(_numbered(counts, series, "_s")), cut(_numbered(counts, unit, "_u"))
    n_series, n_units = of_series.count(), of_units.count()
    kinds, names = dict(counts.dtypes), list(sides)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in cells), outputs])

    def run(table: pa.Table) -> pa.Table:
        i, j = table["_s"].to_numpy(), table["_u"].to_numpy()
        mine, at = np.unique(i, return_inverse=True)  # the cell's own series
        sums = {}
        for name in names:
            sums[name] = np.zeros((len(mine), n_units))
            np.add.at(sums[name], (at, j), table[name].to_numpy().astype(float))
        units = int((sums["n"].sum(0) > 0).sum())
        v = unit_weights(n_units, n, seed, block) if units >= 3 else np.ones((n, n_units))
        drawn = {f"{name}{within}": np.zeros(n) for name in names for within in ("", "_in")}
        for first, w in series_weights(n_series, n, seed):
            some = slice(first, first + len(w))
            for name, x in sums.items():
                by_unit = w[:, mine] @ x
                drawn[name][some], drawn[f"{name}_in"][some] = (by_unit * v[some]).sum(1), by_unit.sum(1)
        out = finish({k: x.sum() for k, x in sums.items()}, drawn) | {"units": units}
        return pa.table({**{c: table[c].slice(0, 1) for c in cells}, **{c.split()[0]: pa.array([out[c.split()[0]]], pa.int64() if c.endswith(" long") else pa.float64()) for c in outputs.split(", ")}})

    return counts.join(of_series, series).join(of_units, unit).groupBy(*cells).applyInArrow(run, schema)


def _interval(values: np.ndarray) -> tuple[float | None, float | None]:
    return tuple(map(float, np.percentile(values, [2.5, 97.5]))) if len(values) else (None, None)


def two_way_share(rows: DataFrame, cells: list[str], series: str, unit: str, event: str, n: int = 1000, seed: int = 0, block: int = 3) -> DataFrame:
    """Share of `event` by cell, with a two-way bootstrap interval, and one for which only series are
    drawn (within periods).

    Cells with fewer than three units resample series only; replicates without rows are counted
    and left out.
    """

    def finish(total: dict, drawn: dict) -> dict:
        ok, ok_in = drawn["n"] > 0, drawn["n_in"] > 0
        lo, hi = _interval(drawn["k"][ok] / drawn["n"][ok])
        lo_in, hi_in = _interval(drawn["k_in"][ok_in] / drawn["n_in"][ok_in])
        return {"share": float(total["k"] / total["n"]) if total["n"] else None, "lo": lo, "hi": hi, "lo_within": lo_in, "hi_within": hi_in, "n": int(total["n"]), "zero_den": int((~ok).sum())}

    k, m = F.col(event).cast("long"), F.col(event).isNotNull().cast("long")
    outputs = "share double, lo double, hi double, lo_within double, hi_within double, n long, units long, zero_den long"
    return _two_way(rows, {"k": k, "n": m}, cells, series, unit, finish, outputs, n, seed, block)


def two_way_difference(a: DataFrame, b: DataFrame, cells: list[str], series: str, unit: str, event: str, n: int = 1000, seed: int = 0, block: int = 3) -> DataFrame:
    """Difference of the shares of `event` (b less a) by cell; a replicate draws the same series and
    units for both sides."""
    both = a.select(*cells, series, unit, F.lit(0).alias("_side"), F.col(event).alias("_e")).unionByName(b.select(*cells, series, unit, F.lit(1).alias("_side"), F.col(event).alias("_e")))
    there, mine = F.col("_e").isNotNull(), lambda k: F.col("_side") == k
    sides = {"k0": (F.col("_e") & mine(0)), "n0": (there & mine(0)), "k1": (F.col("_e") & mine(1)), "n1": (there & mine(1)), "n": there}

    def finish(total: dict, drawn: dict) -> dict:
        ok = (drawn["n0"] > 0) & (drawn["n1"] > 0)
        lo, hi = _interval(drawn["k1"][ok] / drawn["n1"][ok] - drawn["k0"][ok] / drawn["n0"][ok])
        whole = total["n0"] and total["n1"]
        return {"diff": float(total["k1"] / total["n1"] - total["k0"] / total["n0"]) if whole else None, "lo": lo, "hi": hi, "n0": int(total["n0"]), "n1": int(total["n1"]), "zero_den": int((~ok).sum())}

    return _two_way(both, {k: F.coalesce(c.cast("long"), F.lit(0)) for k, c in sides.items()}, cells, series, unit, finish, "diff double, lo double, hi double, n0 long, n1 long, units long, zero_den long", n, seed, block)


def joint_bootstrap(a: DataFrame, b: DataFrame, keys: list[str], unit: str, target: str, metric: str = "wis", n: int = 1000, seed: int = 0) -> DataFrame:
    """Relative change of each target and their geometric mean, with 95 % percentile intervals.

    A replicate draws the same units for all targets; a unit counts where every target has it. The
    last row, of a null target, is the geometric mean. One group of targets x units means.
    """
    ship(a.sparkSession)
    units = paired(a, b, keys, metric).groupBy(target, unit).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))

    def run(table: pa.Table) -> pa.Table:
        names, i = np.unique(np.array(table[target].to_pylist(), object), return_inverse=True)
        days, j = np.unique(np.array(table[unit].to_pylist(), object), return_inverse=True)
        x, y = (np.full((len(names), len(days)), np.nan) for _ in range(2))
        x[i, j], y[i, j] = table["a"].to_numpy(), table["b"].to_numpy()
        whole = ~(np.isnan(x) | np.isnan(y)).any(0)
        x, y = x[:, whole], y[:, whole]
        if not x.shape[1]:
            return pa.table({target: pa.array([], pa.string()), **{c: pa.array([], pa.float64()) for c in ("rel", "lo", "hi")}, "units": pa.array([], pa.int64())})
        idx = np.random.default_rng(seed).integers(0, x.shape[1], (n, x.shape[1]))
        ratio, drawn = y.mean(1) / x.mean(1), y[:, idx].mean(2) / x[:, idx].mean(2)
        values = [*(ratio - 1), np.exp(np.log(ratio).mean()) - 1]
        low, high = np.percentile(np.vstack([drawn - 1, np.exp(np.log(drawn).mean(0)) - 1]), [2.5, 97.5], axis=1)
        return pa.table({target: pa.array([*names.tolist(), None], pa.string()), "rel": pa.array(values, pa.float64()), "lo": pa.array(low), "hi": pa.array(high), "units": pa.array([x.shape[1]] * len(values), pa.int64())})

    read = units.withColumn(target, F.col(target).cast("string")).withColumn("_all", F.lit(1))
    return read.groupBy("_all").applyInArrow(run, f"{target} string, rel double, lo double, hi double, units long")
