"""The near stage against brute-force Jaccard similarity of 5-word shingles."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def least_reachable(texts):
    sets, root = {d: shingles(t) for d, t in texts}, {d: d for d, _ in texts}
    for a in sets:
        for b in sets:
            if root[a] != root[b] and similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def planted(rng, pairs=60, n=300):
    """Pairs of a text and a copy with 1 to 7 words changed, the similarity of each above 0.8."""
    out = []
    while len(out) < 2 * pairs:
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        copy = list(words)
        for at in rng.sample(range(n), rng.randrange(1, 8)):
            copy[at] = f"x{rng.randrange(5000)}"
        if similarity(shingles(" ".join(words)), shingles(" ".join(copy))) >= 0.8:
            out += [" ".join(words), "\n".join(copy).upper()]
    return out


def test_near_stage_links_every_planted_pair(spark):
    texts = planted(random.Random(7))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(range(0, len(texts), 2))


def test_components_are_those_of_all_similar_pairs(spark):
    """Odd texts, a dense group, and spokes that are near their base but not near each other."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    texts = ["", None, " \n", "x", "X ", "a b c d", "a b c d e", "é" * 50, "\0 nul", *planted(rng, 10, 60)]
    for k in range(30):
        spoke = list(base)
        for at in rng.sample(range(200), 4 if k else 0):
            spoke[at] = f"s{k}"
        texts.append(" ".join(spoke))
    for k in range(20):
        texts.append(" ".join(base[:100] + [f"t{k}_{j}" for j in range(rng.randrange(10, 60))]))
    rng.shuffle(texts)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert got == least_reachable(rows)
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_fingerprints_are_majorities_of_the_bits_of_a_set():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 2, 5, 31, 32, 33, 64, 700])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    hashes = rng.integers(0, 1 << 63, offsets[-1], np.uint64)
    got = near_copies.fingerprints(hashes, offsets)
    scrambled = hashes.tolist()
    for k in range(near_copies.WORDS):
        scrambled = [x ^ (x >> 32) for x in ((x * int(near_copies.FACTORS[k])) % (1 << 64) for x in scrambled)]
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            assert int(got[i, k]) == sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in scrambled[a:b]) > b - a)
    assert near_copies.fingerprints(hashes[:0], offsets[:1]).shape == (0, near_copies.WORDS)


def test_posting_lists_keep_every_possible_partner():
    """Lists of all lengths, cut anywhere by batches; crowded ones pass whole."""
    rng = np.random.default_rng(4)
    keys = np.repeat(np.arange(300), rng.choice([1, 1, 2, 3, 20, 31, 32, 33, 34, 90], 300))
    after = rng.integers(0, 1 << 63, len(keys), np.int64)
    close = rng.random(len(keys)) < 0.3
    after[close] = 0x0F0F ^ (1 << rng.integers(0, 62, close.sum()))
    words = after.view(np.uint64)
    want = set()
    for at in range(len(keys)):
        same = np.flatnonzero(keys == keys[at])
        bits = np.bitwise_count(words[same] ^ words[at])
        if len(same) > near_copies.CROWDED or (bits[same != at] <= near_copies.MOST_BITS).any():
            want.add(at)
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys))), pa.array(after)], ["key", "node", "after"])
    for width in (1, 7, 40, 1000, len(keys)):
        cut = (whole.slice(at, width) for at in range(0, len(keys), width))
        got = [x for batch in near_copies.partnered(iter([whole.slice(0, 0), *cut])) for x in batch.column(1).to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want, width
    assert list(near_copies.partnered(iter([]))) == []


def test_short_texts_and_the_tally_of_positional_bytes(spark, monkeypatch):
    """Pairs of 8 and 9 words, of similarity 0.8 exactly; without enough equal positional bytes a pair is no link."""
    rng = random.Random(9)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(9)) for _ in range(150)]
    rows = [(2 * k + side, t if side else t.rsplit(" ", 1)[0]) for k, t in enumerate(texts) for side in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == {d: d // 2 * 2 for d, _ in rows}
    monkeypatch.setattr(near_copies, "LEAST_EQUAL", 8 * near_copies.WORDS + 1)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == {d: d for d, _ in rows}


def test_a_loose_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts near a base that is not there and not near each other; some have copies, near them or chained, some lie near the reference."""
    rng = random.Random(10)
    changed = lambda words, n, tag: [f"{tag}_{k}" if k in at else w for at in [set(rng.sample(range(len(words)), n))] for k, w in enumerate(words)]
    base = [f"b{k}" for k in range(200)]
    texts = [changed(base, 5, f"s{k}") for k in range(240)]
    texts += [changed(texts[k], 2, f"t{k}") for k in range(40)]
    texts += [changed(texts[k], 3, f"u{k}") for k in range(240, 260)]
    texts += [changed(base, rng.randrange(1, 12), f"v{k}")[: rng.randrange(150, 200)] for k in range(60)]
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    compared, write = [], near_copies.written

    def written(df, tag):
        out = write(df, tag)
        if tag.startswith("pairs-"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "written", written)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == least_reachable(rows)
    assert len(compared) == 3 and sum(compared) < 10 * len(texts), compared


def test_every_similar_pair_of_a_group_shares_rare_differences(spark):
    """Sets of many sizes around a center that is none of them: of similar pairs that the hub does not join, none is missed, and few others are found."""
    rng = random.Random(11)
    center = set(range(120))
    group = [set(rng.sample(sorted(center), rng.randrange(60, 121))) | set(rng.sample(range(120, 160), rng.randrange(0, 20))) for _ in range(150)]
    group += [x ^ set(rng.sample(range(160), rng.randrange(1, 14))) for x in group[:100]]
    schema = "ref long, node long, n int, w int, d array<long>, label long, far boolean, hub_w int"
    for tenths in (6, 8, 9):
        w = [(10 + tenths) * len(x ^ center) - (10 - tenths) * len(x) for x in group]
        hub = w.index(min(w))
        similar = [[10 * len(x & y) >= tenths * len(x | y) for y in group] for x in group]
        label = [hub if near else k for k, near in enumerate(similar[hub])]
        rows = [(0, k, len(x), w[k], sorted(x ^ center), label[k], label[k] != hub, w[hub]) for k, x in enumerate(group)]
        got = [tuple(sorted(r)) for r in near_copies.rare_pairs(spark.createDataFrame(rows, schema), tenths).collect()]
        want = {(a, b) for a in range(len(group)) for b in range(a + 1, len(group)) if similar[a][b] and label[a] != label[b]}
        assert want and want <= set(got), (tenths, len(want), len(want - set(got)))
        assert all(label[a] != label[b] for a, b in got)
