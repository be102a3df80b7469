"""Every core query that has SQL against that SQL, over the whole smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from stemma import plans


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def bag(rows):
    return Counter(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, data, db, name):
    got = plans.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    res = db.execute(plans.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(dict(zip(names, r))[c] for c in cols) for r in res.fetchall()]
    assert bag([tuple(r) for r in got.select(*cols).collect()]) == bag(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_without_sql_runs(spark, data, name):
    df = plans.QUERIES[name](spark, data)
    assert df.columns
    df.count()
