"""Every query of the reference's operators against its SQL, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from glintframe.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind == "M":
            df[k] = df[k].astype("datetime64[us]").astype(str)
        elif df[k].dtype.kind in "fiu":
            df[k] = df[k].astype(float).round(6) + 0.0
        else:
            df[k] = df[k].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    pd.testing.assert_frame_equal(plain(registry.QUERIES[name](spark, FOLDER).toPandas()), plain(duck.sql(registry.ORACLE_SQL[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert not registry.QUERIES[name](spark, FOLDER).isEmpty()


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
