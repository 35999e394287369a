"""Every registered query that has SQL, against that SQL in DuckDB over the small tables."""

import os

import duckdb
import pytest

from loomspan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test data is not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 6) if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    assert got == sorted((tuple(plain(dict(zip(order, r, strict=True))[c]) for c in names) for r in found.fetchall()), key=repr)
