"""Registered queries against DuckDB where partitions are left as they were dealt, as on large tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["dense_topk", "dense_eval_hit_mrr", "compare_indexes", "vector_hybrid"])
def test_spread_out(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        rows = entry.queries()[name](spark, DATA).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in rows) == plain(want.fetchall())
