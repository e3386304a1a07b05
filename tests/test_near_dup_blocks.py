"""Fingerprints hashed over many texts at once are those of each text alone, and are made once."""

import random

import pytest

from siltstone.operators import near_dup as nd
from siltstone.plans.catalog import CATALOG


def alone(text, k, w):
    tokens = nd.TOKEN.findall(text)
    grams = []
    for i in range(len(tokens) - k + 1):
        value = 0
        for t in tokens[i : i + k]:
            value = (value * nd.BASE + nd.token_hash(t)) % nd.PRIME
        grams.append(value)
    return sorted(set(grams if len(grams) < w else (min(grams[i : i + w]) for i in range(len(grams) - w + 1))))


@pytest.mark.parametrize("block, many", [(1, 1_000_000), (40, 1_000_000), (16_384, 1_000_000), (40, 5)])
def test_texts_are_hashed_in_blocks(monkeypatch, block, many):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "MANY", many)
    pick = random.Random(7)
    texts = [" ".join(pick.choice("a b c d e f g".split()) for _ in range(pick.choice([0, 1, 4, 5, 6, 8, 30]))) for _ in range(60)]
    for k, w in ((5, 4), (3, 1), (1, 2)):
        assert nd.winnow(texts, k, w, {}) == [alone(t, k, w) for t in texts]
    assert nd.winnow([], 5, 4, {}) == []


def test_pairs_read_written_fingerprints(spark):
    plan = CATALOG["near_dup_pairs"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan
