"""Every query of the record engine against its SQL, over the smallest tables."""

import collections
import glob
import os

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


def flat(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = got.collect()
    if name not in catalog.ORACLES:
        assert got.columns
        return
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    as_rows = collections.Counter(tuple(flat(r[c]) for c in cols) for r in found)
    assert as_rows == collections.Counter(tuple(flat(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
