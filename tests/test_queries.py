"""Every query that has SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

import __spark_entry__
from parcelwise.queries import details, documents, extractions, pipeline, survey

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = survey.QUERIES | documents.QUERIES | details.QUERIES | pipeline.QUERIES | extractions.QUERIES, survey.SQL | documents.SQL | details.SQL | pipeline.SQL | extractions.SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted((repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall()))
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
