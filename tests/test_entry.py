"""Driver contract: every registered query runs at sf0.001 and matches its
DuckDB oracle (the same comparison the correctness gate makes at sf0.01)."""

import datetime as dt
import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from wattle.plans.catalog import QUERIES
from conftest import SF_CHECK, SF_SMALL

ROWS_ONLY: set[str] = set()   # every registered query has an oracle
# Natural data has no complete day at sf0.001; these run one scale up.
SCALE = {"events_complete_days": SF_CHECK, "events_weekend_curve": SF_CHECK}


def _norm(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    cons = {}
    for sf in (SF_SMALL, SF_CHECK):
        con = duckdb.connect()
        for path in sorted(pathlib.Path(sf).glob("*.parquet")):
            con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
        cons[sf] = con
    return cons


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "Daily Sent" in df.columns


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    sf = SCALE.get(key, SF_SMALL)
    sdf = entry.queries()[key](spark, sf)
    srows = sdf.collect()
    assert len(srows) > 0
    if key in ROWS_ONLY:
        return
    rel = duck[sf].execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    a = sorted(tuple(_norm(r[c]) for c in order) for r in srows)
    b = sorted(tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows)
    assert a == b
