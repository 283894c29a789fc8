"""A sample of the registered queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from checks.compare import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["flagship", "candidates_plain", "preorder", "point_uuid", "filtered_topk", "signals", "rerank", "decompose", "parse_verdict"]


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in rel.description], rel.fetchall())


def test_every_query_is_registered_once():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
