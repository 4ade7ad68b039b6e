"""Every query with oracle SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from auditloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind not in "fiub":
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    got, want = canon(registry.queries()[name](spark, SF).toPandas()), canon(duck.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1.1e-6, equal_nan=True)
        elif c not in ("day", "date", "ts"):
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_every_name_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())
