"""First-fit packing in rounds against the plain walk, ranks within keys, the whole selection."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.operators import context as ctx


def plain(rows, budget):
    taken, left = [], budget
    for name, tokens in rows:
        if 0 < tokens <= left:
            left -= tokens
            taken.append(name)
    return taken


@pytest.mark.parametrize(("budget", "walked", "high"), [(5000, 0, 3000), (5000, 40, 400), (100_000, 0, 900), (77, 3, 90), (1, 0, 3), (0, 0, 3)])
def test_rounds_take_what_the_walk_takes(spark, budget, walked, high):
    rng = random.Random(budget + walked)
    rows = [(f"p{k:04}", rng.choice([0, 1, rng.randrange(1, high), high, rng.randrange(1, high)])) for k in range(700)]
    df = ctx.placed(spark.createDataFrame(rows, "path string, tokens long").repartition(3), [F.asc("path")], 9)
    taken = ctx.first_fit(df, budget, walked)
    got = sorted(r["path"] for r in df.where(taken.condition()).collect())
    assert got == plain(rows, budget)
    assert taken.used == sum(t for n, t in rows if n in set(got))
    assert len(taken.ranges) <= max(budget, 1).bit_length() + 1


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), k) for k in range(900)]
    got = {r["k"]: r["rank"] for r in ctx.rank_within(spark.createDataFrame(rows, "m string, v int, k int"), "m", [F.desc("v"), F.asc("k")]).collect()}
    groups = defaultdict(list)
    for m, v, k in rows:
        groups[m].append((-v, k))
    assert got == {k: n + 1 for g in groups.values() for n, (_, k) in enumerate(sorted(g))}


def test_selection(spark):
    rows = [("src/a.rs", "src", 100, 900), ("src/b.rs", "src", 90, 5000), ("x/README.md", "x", 1, 40), ("y/Cargo.toml", "y", 1, 30), ("go.sum", "", 500, 10), ("vendor/v.js", "vendor", 800, 4000), ("z.min.js", "", 700, 5), ("t/small.rs", "t", 1, 20)]
    df = spark.createDataFrame([(p, m, "L", "parent", c, 0, 0, 100, t * 4, t) for p, m, c, t in rows], "path string, module string, lang string, kind string, code long, comments long, blanks long, lines long, bytes long, tokens long")
    got = {r["path"]: (r["tokens"], r["policy"], r["reason"]) for r in ctx.select_context(df, 10_000, metric="churn").collect()}
    assert got == {"x/README.md": (40, "full", "spine"), "y/Cargo.toml": (30, "full", "spine"), "src/a.rs": (900, "full", "code"), "src/b.rs": (1500, "head_tail", "code"), "t/small.rs": (20, "full", "code")}
    scores = spark.createDataFrame([("t/small.rs", 9, 9)], "path string, hotspot long, churn long")
    few = {r["path"] for r in ctx.select_context(df, 1000, "spread", "churn", scores).collect()}
    assert "t/small.rs" in few
    assert ctx.select_context(df.limit(0), 1000).count() == 0


def test_budgets():
    assert [ctx.parse_budget(x) for x in ("50000", " 128K", "1.5k", "0.5m", "1g", "0")] == [50_000, 128_000, 1500, 500_000, 10**9, 0]
    assert ctx.parse_budget("max") == ctx.parse_budget("Unlimited") == 2**64 - 1
    for bad in ("", "k", "x", "-1", "1e30", "nan", "inf"):
        with pytest.raises(ValueError, match="invalid budget"):
            ctx.parse_budget(bad)
