"""Every registered query with SQL against DuckDB on the smallest tables, where they are there."""
import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

import __spark_entry__ as entry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return tuple(map(cell, x)) if isinstance(x, (list, tuple)) else x if x is None or isinstance(x, (str, bool)) else float(x) if hasattr(x, "__float__") else str(x)


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {q for q in entry.queries() if q.startswith("op") or q == "pipeline"}))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 30
