"""Every query with SQL against DuckDB on the same tables; the others must run."""

import duckdb
import pandas as pd
import pytest

from skeinflow.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else round(x, 5) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got = queries()[name](spark, sf).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0
