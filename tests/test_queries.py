"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os
import sys
from glob import glob

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lexiloom.plans import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    cursor = duck.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert rows == sorted(repr([plain(r[at[c]]) for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLES.keys()))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_lzma_comes_back(spark):
    assert queries.lzma_size(spark, SF).where("not whole").count() == 0
