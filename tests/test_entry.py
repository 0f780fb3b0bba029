"""A few registered queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["dense_topk", "classify_sections", "context_search", "answer_policy", "chunk_spans", "index_build_resumed", "family_split_balanced", "trace_store", "xml_snapshot", "judge_repair"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want.fetchall())
