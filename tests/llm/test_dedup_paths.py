"""op1 and op3: texts whose 64-bit hashes are equal, many texts of one id or without one, and what is left behind."""

import hashlib
import os
import random
from collections import Counter

import pytest

from siltstone.llm import substring_dedup, suffix_dedup, superkmers


def thue_morse(n, a, b):
    return "".join(b if k.bit_count() & 1 else a for k in range(n))


@pytest.fixture(params=[False, True], ids=["as planned", "all crowded"])
def ways(request, monkeypatch):
    if request.param:
        original = superkmers.shared_minimizers
        for module in (substring_dedup, suffix_dedup):
            monkeypatch.setattr(module, "shared_minimizers", lambda texts, parts, scheme, **_: original(texts, parts, scheme, least=2, share=1 << 40))


def substring_by_hand(rows, width=50):
    first = {}
    split = [((d is None, d or 0), (t or "").split()) for d, t in rows]
    for d, ws in sorted(split):
        for i in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[i : i + width]), d)
    out = []
    for d, ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((d[1], len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def suffix_by_hand(rows, width=200):
    data = [((d or 0), (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((d, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def found(df):
    names = [c for c in ("n_words", "n_bytes") if c in df.columns]
    return Counter((r["doc_id"] or 0, r[names[0]], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_words_of_equal_polynomial_hash_are_different(spark, ways):
    """Sums modulo 2^64 agree on a word of 1024 letters and on the same word with its letters exchanged."""
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    before, after = " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    rows = [(1, f"{before} {one} {after}"), (2, f"{before} {two} {after}"), (3, f"{before} {one} {after} tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring_dedup.substring_dedup(docs)) == substring_by_hand(rows)
    assert found(suffix_dedup.suffix_dedup(docs)) == suffix_by_hand(rows)


def test_many_texts_without_an_id_and_under_one(spark, ways):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))

    def text():
        body = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))
        return f"{body} {passage} {body}" if rng.random() < 0.05 else body

    rows = [(None, text()) for _ in range(5000)] + [(1, text()) for _ in range(3000)] + [(2, text()) for _ in range(600)] + [(7, f"start {passage}"), (7, f"start {passage}"), (0, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(substring_dedup.substring_dedup(docs)) == substring_by_hand(rows)
    assert found(suffix_dedup.suffix_dedup(docs)) == suffix_by_hand(rows)


def test_intermediate_tables_go(spark):
    docs = spark.createDataFrame([(1, "a b " * 60), (2, "a b " * 60 + "c")], "doc_id long, text string")
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    tables, files = len(spark.catalog.listTables()), len(os.listdir(at))
    assert substring_dedup.substring_dedup(docs).count() == suffix_dedup.suffix_dedup(docs).count() == 2
    assert len(spark.catalog.listTables()) == tables and len(os.listdir(at)) == files + 2  # the two results


def test_runs_are_merged_in_sorted_order(spark):
    """Six binomial rounds over sorted runs: the rounds' plan aggregates in order, and no Python worker takes part."""
    from pyspark.sql import functions as F

    from siltstone.llm import exact_dedup
    from siltstone.llm.shared import merging_sorted

    rows = spark.createDataFrame([(k, f"text {k % 37}") for k in range(500)], "doc_id long, text string").repartition(7)
    digests = exact_dedup.digest_runs(rows, "doc_id", "text", 64)
    one = exact_dedup.tree_merge(digests, "largest", 64).collect()
    assert len(one) == 37 and sum(r["group_size"] for r in one) == 500 and sorted(r["keep_id"] for r in one) == list(range(463, 500))
    order = ["run", *exact_dedup.KEY]
    with merging_sorted(spark):
        plan = digests.repartition("run").sortWithinPartitions(*order).groupBy(*order).agg(F.first("id"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan
