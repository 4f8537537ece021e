"""The queries of the problems with SQL against DuckDB on the smallest tables; the others give their columns and rows."""

import glob
import os

import duckdb
import pytest

from stanzaflow.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
COLUMNS = {
    "p1_found": ["poem_id", "lang"], "p2_found": ["poem_id_a", "poem_id_b"], "p3_found": ["field", "row_key"], "p4_found": ["poem_id", "sentence_id", "end_char"],
    "p5_found": ["poem_id", "perspective"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute("select " + ", ".join(cols) + f" from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns) and len(df.columns) == len(set(df.columns))
    rows = df.collect()
    if name in COLUMNS:
        assert rows and len(set(rows)) == len(rows)
