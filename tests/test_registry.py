"""Every query of the core against DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import oracle, registry


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return [plain(y) for y in x]
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return None if math.isnan(x) else round(float(x), 6)
    return str(x)


def same(df):
    return sorted(repr([plain(x) for x in row]) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(tables):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, tables, duck, name):
    found = registry.queries()[name](spark, tables).toPandas()
    assert len(found.columns) == len(set(found.columns))
    if name in oracle.SQL:
        expected = duck.execute(oracle.SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert same(found) == same(expected)


def test_oracles_have_queries():
    assert set(oracle.SQL) <= set(registry.queries())
