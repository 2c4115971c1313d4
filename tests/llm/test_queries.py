"""Every query of the operators and the pipeline on empty tables, and on rows with nulls and other columns."""

import os

import pytest
from pyspark.sql import functions as F

from gristmill.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are not here")
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    for name in TABLES:
        df = spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0 if request.param == "empty" else 6)
        if request.param == "nulls":
            held = [list(r) for r in df.collect()]
            for i, r in enumerate(held):
                r[i % len(r)] = None
            held += [[None] * len(df.columns)] * 2 + held[-1:]
            df = spark.createDataFrame([tuple(r) for r in held], df.schema)
            for clash in ("part", "print", "rank", "key", "grp", "score"):
                df = df.withColumn(clash, F.lit("x"))
        df.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_query(spark, folder, name):
    if name == "pipeline":
        import corpus_pipeline

        corpus_pipeline.run(spark, folder).collect()
    else:
        found = queries.queries()[name](spark, folder).collect()
        expected = {"op4_quality", "op5_neardup", "op7_tokencounts", "op9_suffixes", "op10_fingerprints", "op3_pieces"}
        if name in expected:
            assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SMALL}/{t}'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted(str([r[c] for c in columns]) for r in found)
    assert rows(got.collect()) == rows([dict(zip(want.columns, r)) for r in want.fetchall()])
