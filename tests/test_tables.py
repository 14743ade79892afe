"""Every table query against its SQL, as the driver compares them."""

import glob
import os

import duckdb
import pytest

from codequarry.plans import source_queries, table_queries

QUERIES = table_queries.QUERIES | source_queries.QUERIES
SQL = table_queries.SQL | source_queries.SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(str, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.sql(SQL[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score", "n_chars", "pick", "used_n_chars"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
