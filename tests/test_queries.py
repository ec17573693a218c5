"""Every query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]) or df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA else str(x))
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = ordered(registry.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(registry.SQL[name]).df())
    assert len(want), "a vacuous query"
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-9 if name != "oe_pixels" else 2e-6)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
