"""Series that move together: rank correlations of their changes, and draws coupled by them.

A group is one hierarchy level (tens of series), whose matrix has as many cells as pairs are asked for.
Ranks are windows and a pair's moments one aggregate with partial sums, so histories may be of any
length; only the small matrix of a group meets in a task.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import normal_quantile, uniform
from tidemark.operators.decide import value_at
from tidemark.session import ship

SHRINK = 0.2
LEAST = 12
FLOOR = 1e-6


def changes(panel: DataFrame, by: list[str]) -> DataFrame:
    """by, series, period, change of the log from the month before, where both are positive."""
    step = F.log(F.when(F.col("y") > 0, F.col("y")))
    before = F.lag(step).over(Window.partitionBy(*by, "series").orderBy("period"))
    return panel.select(*by, "series", "period", F.round(step - before, 9).alias("change")).where("change is not null")


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ranks of a series' changes among its own; equal ones share their mean rank."""
    w = Window.partitionBy(*by, "series").orderBy("change")
    tied = F.count("*").over(Window.partitionBy(*by, "series", "change"))
    return rows.select(*by, "series", "period", (F.rank().over(w) + (tied - 1) / 2).alias("rank"))


def correlations(rows: DataFrame, by: list[str], shrink: float = SHRINK, least: int = LEAST) -> DataFrame:
    """by, a, b (a < b), n common months, rho of ranks, and r, the correlation of normal scores that has this
    rank correlation, shrunk towards none. Pairs with fewer than `least` months, or without
    variation, have r = 0."""
    ranks = ranked(rows, by)
    left = ranks.select(*by, "period", F.col("series").alias("a"), F.col("rank").alias("_a"))
    right = ranks.select(*by, "period", F.col("series").alias("b"), F.col("rank").alias("_b"))
    rho = F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))
    pairs = left.join(right, [*by, "period"]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("n"), rho.alias("rho"))
    rho = F.when(F.col("n") >= least, F.col("rho"))
    return pairs.select(*by, "a", "b", "n", rho.alias("rho"), F.coalesce((1 - shrink) * 2 * F.sin(rho * pi / 6), F.lit(0.0)).alias("r"))


def positive(r: np.ndarray) -> np.ndarray:
    """The correlation matrix that is left when no eigenvalue may be below FLOOR."""
    values, vectors = np.linalg.eigh(r)
    out = (vectors * np.maximum(values, FLOOR)) @ vectors.T
    scale = 1 / np.sqrt(np.diag(out))
    return out * scale[:, None] * scale


def matrices(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, series, names (of the group, in order) and row: the series' row of a positive definite matrix."""
    ship(pairs.sparkSession)
    kinds = dict(pairs.dtypes)

    def run(table: pa.Table) -> pa.Table:
        a, b = table["a"].to_pylist(), table["b"].to_pylist()
        names = sorted({*a, *b})
        at = {s: i for i, s in enumerate(names)}
        m = np.eye(len(names))
        i, j = [at[s] for s in a], [at[s] for s in b]
        m[i, j] = m[j, i] = table["r"].to_numpy()
        keys = {c: pa.array([table[c][0].as_py()] * len(names), table.schema.field(c).type) for c in by}
        return pa.table({**keys, "series": pa.array(names), "names": pa.array([names] * len(names)), "row": pa.array(positive(m).tolist(), pa.list_(pa.float64()))})

    return pairs.select(*by, "a", "b", "r").groupBy(*by).applyInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "series string, names array<string>, row array<double>"]))


def coupled_draws(forecasts: DataFrame, matrix: DataFrame, by: list[str], keys: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """forecasts (keys, series, q) with draws; within keys, which hold `by`, draw k of all series is one
    joint draw whose normal scores have the matrix's correlations. Series that the matrix does not know are drawn
    on their own.

    Scores come from hashes of (seed, keys, series, draw) and are mixed in one small group a cell, so neither
    partitions nor retries change them.
    """
    ship(forecasts.sparkSession)
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys), F.col("series"))
    alone = F.transform(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda k: uniform(F.col("_k"), k)), normal_quantile)
    scored = forecasts.where("q is not null").select(*keys, "series", "q", key.alias("_k")).withColumn("z", alone).drop("_k")
    known = scored.join(matrix, [*by, "series"], "left")
    columns = [*keys, "series", "q", "z"]
    kinds = dict(known.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("series")
        names = table["series"].to_pylist()
        z = np.array(table["z"].to_pylist())
        m = np.eye(len(names))
        for i, (cols, row) in enumerate(zip(table["names"].to_pylist(), table["row"].to_pylist(), strict=True)):
            if row is not None:
                of = dict(zip(cols, row, strict=True))
                m[i] = [of.get(s, float(s == names[i])) for s in names]
        mixed = np.linalg.cholesky(m) @ z
        numbers = pa.list_(pa.float64())
        return pa.table({**{c: table[c] for c in (*keys, "series")}, "q": table["q"].cast(numbers), "z": pa.array(mixed.tolist(), numbers)})

    coupled = known.groupBy(*keys).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))
    logs = F.transform("q", lambda v: F.log(F.greatest(v, F.lit(1e-9))))
    return coupled.withColumn("_l", logs).select(*keys, "series", F.transform("z", lambda x: value_at(F.col("_l"), x)).alias("draws"))
