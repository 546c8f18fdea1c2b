"""Queries register themselves here with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that sums taken in another order compare equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, and every day a date."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" else F.transform(c, lambda x: F.round(x, digits)).alias(c) if kinds[c] == "array<double>" else F.col(c) for c in df.columns))
