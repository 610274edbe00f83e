"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from marketframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        df[c] = df[c].astype(float) if kind.startswith(("float", "Float", "int", "Int", "bool")) else df[c].map(lambda x: None if x is None or x is pd.NA else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    for c in a.columns:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c].astype(float), rtol=1e-9, atol=1.1e-4, equal_nan=True), c
        else:
            assert a[c].fillna("").tolist() == b[c].fillna("").tolist(), c


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() == 1
