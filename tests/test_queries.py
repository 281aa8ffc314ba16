"""Every query against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from strandline.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert rows
    if name in ORACLES:
        found = con.execute(ORACLES[name])
        theirs = [c[0] for c in found.description]
        assert sorted(theirs) == names
        at = [theirs.index(c) for c in names]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_every_name_has_rows_to_check():
    assert set(ORACLES) <= set(QUERIES)
