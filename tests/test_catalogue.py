"""Every query of the catalogue against its SQL, and on empty tables."""

import os

import pytest

from gristmill import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in os.listdir(SMALL):
        spark.read.parquet(f"{SMALL}/{name}").limit(0).write.parquet(f"{folder}/{name}")
    return folder


def rows(found, columns):
    return sorted(str([r[c] for c in columns]) for r in found)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, empty, name):
    got = queries.QUERIES[name](spark, SMALL)
    assert queries.QUERIES[name](spark, empty).schema == got.schema
    queries.QUERIES[name](spark, empty).collect()
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows(got.collect(), columns) == rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)
