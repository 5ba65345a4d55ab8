"""Every query of the registry against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from talkloom.plans import registry

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(table):
    return sorted(repr(sorted(r.items())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toArrow()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
    else:
        assert got.num_rows >= 0


def test_entry(spark):
    assert {"video_id", "speaker", "total_ms", "share_pct"} <= set(registry.entry(spark, DATA).columns)
