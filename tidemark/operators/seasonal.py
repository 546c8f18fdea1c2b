"""Seasonal designs and least squares from normal equations: one aggregate a group, solved row by row."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

SEASON = 12


def fourier(period: Column | str, harmonics: int) -> list[Column]:
    """sin and cos of the month for each harmonic; of the sixth, whose sine is zero, the cosine alone."""
    angle = lambda k: F.month(period) * (2 * pi * k / SEASON)
    return [f(angle(k)) for k in range(1, harmonics + 1) for f in ((F.sin, F.cos) if 2 * k < SEASON else (F.cos,))]


def month_contrasts(period: Column | str) -> list[Column]:
    """Eleven columns whose effects and that of December, less their sum, add up to zero."""
    m = F.month(period)
    return [F.when(m == k, 1.0).when(m == SEASON, -1.0).otherwise(0.0) for k in range(1, SEASON)]


def least_squares(rows: DataFrame, by: list[str], x: list[Column], y: Column) -> DataFrame:
    """by, n, b (a coefficient for each column of x) and sse, of rows without a null in x or y.

    Sums of products are one aggregate with partial sums, so a group may have any number of rows; the
    small systems are then solved where they lie. A group with fewer rows than columns, or whose
    columns depend on each other, gets the solution of least norm, as lstsq does.
    """
    ship(rows.sparkSession)
    p = len(x)
    named = rows.select(*by, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)), y.cast("double").alias("_y")).dropna(subset=[*(f"_x{i}" for i in range(p)), "_y"])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    products = F.array(*(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs))
    sums = named.groupBy(*by).agg(F.count("*").alias("n"), products.alias("_xx"), F.array(*(F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(p))).alias("_xy"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"))
    kinds = dict(sums.dtypes)
    upper = tuple(np.array(pairs).T)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, sse = [], []
            for xx, xy, yy in zip(*(batch.column(c).to_pylist() for c in ("_xx", "_xy", "_yy")), strict=True):
                a = np.zeros((p, p))
                a[upper] = xx
                a += np.triu(a, 1).T
                v = np.linalg.pinv(a, hermitian=True) @ np.array(xy)
                b.append(v.tolist())
                sse.append(max(yy - float(v @ np.array(xy)), 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*by, "n"]), pa.array(b, pa.list_(pa.float64())), pa.array(sse, pa.float64())], [*by, "n", "b", "sse"])

    return sums.mapInArrow(solve, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long, b array<double>, sse double"]))
