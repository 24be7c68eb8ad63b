"""Every query with an oracle gives the oracle's rows; the others give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sparkloom.catalog import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, float) or type(v).__name__ in ("Decimal", "float64", "float32"):
        return f"{float(v):.6g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_keys_agree():
    assert set(ORACLE_SQL) <= set(QUERIES)
