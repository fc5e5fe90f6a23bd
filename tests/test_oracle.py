"""Every query with oracle SQL against DuckDB on the smallest tables, whole."""

import pytest
from conftest import SMALL
from verify import oracle, plain

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        relation = duck.sql(SQL[name])
        assert sorted(relation.columns) == columns
        theirs = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
        assert ours == theirs
