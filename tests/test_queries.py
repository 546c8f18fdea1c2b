"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    """Rows sorted by text, columns by name, every missing value one string."""
    df = df[sorted(df.columns)]
    shown = df.map(lambda v: "" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.5f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v))
    return shown.sort_values(list(shown.columns)).reset_index(drop=True)


def holds(name, rows):
    """What must be true of queries that have no SQL."""
    if name == "reconciled_forecasts":
        groups = {(r.target, r.horizon, r.origin) for r in rows}
        return all(r.lo <= r.mid <= r.hi and r.lo >= 0 for r in rows if r.mid is not None) and len(rows) == len({(r.target, r.horizon, r.origin, r.series) for r in rows}) and len(groups) > 1
    if name == "coupled_totals":
        return all(0 <= r.lo <= r.mid <= r.hi for r in rows) and {r.horizon for r in rows} == set(range(1, 7)) and len(rows) == len({(r.origin, r.target, r.horizon, r.region) for r in rows})
    if name.startswith("rolling_"):
        keys = {(r.origin, r.target, r.series, r.horizon) for r in rows}
        return len(keys) == len(rows) and len({r.origin for r in rows}) == 36 and {r.horizon for r in rows} == set(range(1, 7)) and all(0 <= r.lo <= r.mid <= r.hi for r in rows)
    if name.startswith("model_"):
        return len({r.target for r in rows}) == 3 and {r.horizon for r in rows} == set(range(1, 7)) and all(0 <= r.lo <= r.mid <= r.hi for r in rows if r.mid is not None)
    if name == "two_way_bootstrap":
        return all(r.lo <= r.share <= r.hi and r.lo_within <= r.hi_within and r.zero_den <= 1000 for r in rows)
    if name == "two_way_differences":
        return all(r.lo <= r.diff <= r.hi and r.diff >= 0 and r.n0 == r.n1 for r in rows)
    if name == "joint_bootstrap":
        mean = [r for r in rows if r.target is None]
        rel = [1 + r.rel for r in rows if r.target is not None]
        return len(mean) == 1 and abs(math.prod(rel) ** (1 / len(rel)) - 1 - mean[0].rel) < 1e-5 and all(r.lo <= r.rel <= r.hi for r in rows)
    if name == "paired_bootstrap":
        return all(r.diff_lo <= r.diff <= r.diff_hi and r.rel_lo <= r.rel <= r.rel_hi and r.units == rows[0].units for r in rows)
    raise AssertionError(f"nothing is said of {name}")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        rows = df.collect()
        assert rows and holds(name, rows)
        return
    got = df.toPandas()
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    if not a.equals(b):
        diff = (a != b).any(axis=1)
        pytest.fail(f"{diff.sum()} of {len(a)} rows differ\n{a[diff].head(5).to_string()}\n{b[diff].head(5).to_string()}")
