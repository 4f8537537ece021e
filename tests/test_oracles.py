"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import math
import os

import duckdb
import pytest

from stanzaflow.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows(data):
    return sorted((tuple(map(plain, r)) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(catalogue.ORACLES[name]).columns)
    got = rows(df.select(*[f"`{c}`" for c in cols]).collect())
    want = rows(duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
