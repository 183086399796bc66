"""Each query with SQL gives the rows that the SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, tables, name, query, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{tables}/{t}.parquet'")
    out = query(spark, tables)
    cols = sorted(out.columns)
    got = sorted(repr(tuple(r)) for r in out.select(*[f"`{x}`" for x in cols]).collect())
    rel = c.sql(sql)
    assert sorted(rel.columns) == cols, name
    at = [rel.columns.index(x) for x in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    same(spark, tables, name, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
