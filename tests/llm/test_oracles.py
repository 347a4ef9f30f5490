"""The registered queries against their DuckDB text on the supplied tables."""

import pathlib

import duckdb
import pytest

import corpus_pipeline
from wattle.llm.oracle import ORACLE
from wattle.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(pathlib.Path(SMALL).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_its_oracle(spark, duck, key):
    frame = QUERIES[key](spark, SMALL)
    found = duck.execute(ORACLE[key])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in found.fetchall()) == sorted(
        tuple(str(r[c]) for c in names) for r in frame.collect())
