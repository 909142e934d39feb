"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, name):
    got, want = __spark_entry__.queries()[name](spark, small).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
