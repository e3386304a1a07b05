"""Lockfiles in which a package stands twice, against the SQL."""

import datetime

import duckdb
import pytest

from siltstone.operators import lockfiles as locks
from siltstone.plans.code_queries import QUERIES


def test_repeated_keys_count_each_time(spark):
    texts = {
        '{"packages": {"": {}, "a": {"version": "1"}, "a": {"version": "2"}}}': 2, '{"dependencies": {"a": 1, "a": 2}}': 2, '{"packages": {"": {"n": 1, "n": 2}, "a": {}}}': 1, '{"packages": {"a": 1}, "dep': 0,
        '[{"packages": {"a": 1}}]': 0, '{"packages": "{}", "dependencies": {"a": 1}}': 1, '{"packages": {}, "dependencies": {"a": 1}}': 0, "{'packages': {'a': 1}}": 0, '{"packages": null, "dependencies": {"a": null}}': 1, "": 0,
    }
    rows = spark.createDataFrame([(f"{k}/package-lock.json", t) for k, t in enumerate(texts)], "path string, text string")
    got = {r["path"]: r["dependencies"] for r in locks.lockfiles(rows).collect()}
    assert got == {f"{k}/package-lock.json": n for k, n in enumerate(texts.values())}


@pytest.mark.parametrize("name", ["lockfiles", "dependency_report"])
def test_an_order_with_a_part_twice(spark, tmp_path, name):
    orders = [(k, k // 6, "F", 1.0, datetime.datetime(2024, 1, 1), "5-LOW") for k in range(12)]
    items = [(k, 5, 1, 1, float(q), 1.0, 0.0, 0.0, "R", "F", datetime.datetime(2024, 1, 1)) for k in range(12) for q in (3, 7, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    query, sql = QUERIES[name]
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())
