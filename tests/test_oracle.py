"""Every catalogued query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

from siltstone.plans.catalog import CATALOG

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CATALOG.items() if sql is not None and n != "gate_policy"))
def test_matches_oracle(spark, oracle, name):
    query, sql = CATALOG[name]
    result = query(spark, DATA)
    columns = sorted(result.columns)
    got = sorted(([plain(v) for v in r] for r in result.select(columns).collect()), key=repr)
    cursor = oracle.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == expected
