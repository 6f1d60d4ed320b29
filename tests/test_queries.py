"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_matches_its_twin(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in at) for r in result.fetchall()]
    assert _sorted(mine) == _sorted(theirs)


def test_entry_has_rows(spark, sf):
    rows = registry.entry(spark).collect()
    assert sum(r.n_words for r in rows) > 0
