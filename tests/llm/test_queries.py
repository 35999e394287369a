"""The registered queries that have SQL, against it in DuckDB over the small tables."""

import os

import duckdb
import pytest

from loomspan.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test data is not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in "documents embeddings benchmark conversations".split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(dict(zip(order, r, strict=True))[c] for c in names) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_a_row_for_each_row(spark, name):
    rows = spark.read.parquet(f"{SF}/{'pages' if name == 'op10_html' else 'documents'}.parquet")
    got = queries.QUERIES[name](spark, SF)
    key = got.columns[0]
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())
