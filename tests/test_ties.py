"""Queries against their SQL where rows tie."""

import duckdb

from glosswork.plans.catalog import ORACLE_SQL, QUERIES


def test_islands_of_equal_spans(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table lineitem as select (i % 5)::bigint l_orderkey, (i // 5 % 7)::int l_linenumber, 5 l_quantity, 7 l_partkey, 3 l_suppkey from range(300000) r(i)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    found = QUERIES["overlap_islands"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"select {', '.join(found.columns)} from ({ORACLE_SQL['overlap_islands']})").fetchall())
