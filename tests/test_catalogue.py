"""Every catalogue query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

import tidemark.queries_careers  # noqa: F401
import tidemark.queries_more  # noqa: F401  registers its queries
import tidemark.queries_plans  # noqa: F401
import tidemark.queries_years  # noqa: F401
from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
