"""Every query with SQL gives the SQL's rows over the smallest tables; all others give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from tilewright.plans import all_queries, all_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    def one(v):
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else repr(v)
    return sorted(tuple(one(v[k]) for k in order) for v in values)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, db, name):
    got = all_queries()[name](spark, SF)
    values = [tuple(r) for r in got.collect()]
    if name not in all_sql():
        assert values
        return
    want = db.execute(all_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, values) == rows(names, want.fetchall())
