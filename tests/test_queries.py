"""Every registered query of the library against its SQL, over the smallest tables."""

import math
import os

import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    done = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in done.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == wanted
