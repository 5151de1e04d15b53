"""Each query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from strandwork.plans import registry

TABLES = "customer supplier part orders lineitem events documents embeddings".split()


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        return f"{float(x):.6g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted(map(str, (tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if Path(path).is_dir() else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, data, name):
    found, wanted = registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
