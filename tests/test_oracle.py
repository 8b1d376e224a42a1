"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from skerry import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted([plain(v) for v in r] for r in df.select(*cols).collect())
    if name not in catalog.ORACLE:
        assert rows
        return
    q = con.sql(catalog.ORACLE[name])
    assert sorted(q.columns) == cols
    want = sorted([plain(v) for v in r] for r in q.select(*[f'"{c}"' for c in cols]).fetchall())
    assert rows == want
