"""op11 against a plain ranking, against its SQL, and its parts: bisection, bounds, hashes."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import lexical_search as ls
from siltstone.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id long, text string, item long, score long, rank int, terms string", "item_id long, text string, id string"


def brute(docs, items, top=50):
    counts = [(d, Counter(ls.TERM.findall((t or "").translate(ls.FOLD)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    words = {}
    for k, text in items:
        words.setdefault(k, set()).update(ls.terms_of(text))
    out = set()
    for k, terms in words.items():
        found = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out |= {(k, r + 1, None if missing else d, -s) for r, (s, missing, d) in enumerate(sorted(found)[:top])}
    return out


def fixture(rng):
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "日本", "Ab", "x1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(k, text(rng.randrange(1, 120))) for k in range(900)]
    docs += [(1000 + k, docs[5][1]) for k in range(200)] + [(2000 + k, docs[6][1].upper()) for k in range(70)]  # many equal scores
    docs += [(3000, None), (3001, ""), (3002, "!? _"), (None, docs[5][1]), (None, docs[5][1]), (4, "w1 w1 w2"), (4, docs[5][1]), (3003, text(40_000)), (3004, "w1" * 9000)]
    items = [(k, text(rng.randrange(1, 40))) for k in range(20)] + [(20, docs[5][1]), (21, None), (22, "absent"), (23, "W1"), (24, ""), (5, "w7 é"), (None, "w3 w4")]
    return docs, items


def rows(df):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()}


def test_search_equals_plain_ranking(spark):
    docs, items = fixture(random.Random(1))
    d = spark.createDataFrame([(*x, 1, 2, 3, "t") for x in docs], DOCS).repartition(6)
    q = spark.createDataFrame([(*x, "i") for x in items], ITEMS)
    want = brute(docs, items)
    assert rows(ls.search(d, q)) == want
    # many shards and clusters, several blocks of items
    assert rows(ls.search(d, q, per_shard=3000, leaf=16, block_bytes=700)) == want
    assert rows(ls.search(d, q, top=3, per_shard=9000, leaf=8)) == brute(docs, items, 3)
    assert rows(ls.search(d.limit(0), q)) == set() and rows(ls.search(d, q.limit(0))) == set()


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLE_SQL['op11_lexical_search']})").fetchall()}
    assert want and rows(QUERIES["op11_lexical_search"](spark, DATA)) == want


def test_stopping_is_exact_and_saves_work(spark, monkeypatch):
    """With the known last scores, far fewer clusters are scored than there are, and bounds hold."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.asDict() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    words = [sorted(ls.terms_of(r["text"])) for r in items]
    names = sorted(set().union(*words))
    number = {t: k for k, t in enumerate(names)}
    postings = ls.query_postings(docs, ls.Vocabulary(names), "doc_id", "text").cache()
    df = ls.document_frequencies(postings, len(names))
    n, total = postings.agg(F.count("*"), F.sum("n")).first()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df])
    asked = ls.Items(list(range(len(items))), np.array([number[t] for w in words for t in w]), np.concatenate(([0], np.cumsum([len(w) for w in words]))), weights)
    index = ls.clustered_index(postings, df, n, total, 1 << 20, 32).collect()
    assert len(index) == 1
    row = {k: np.array(index[0][k]) for k in ("ranks", "cluster_starts", "keys", "key_starts", "members", "parts")} | {"ids": index[0]["ids"]}
    shard = ls.Shard(row, len(names))
    bounds = shard.bounds(asked, 0, len(items))
    count = [0]
    original = ls.Shard.scores

    def counted(self, cluster, terms, weights):
        count[0] += 1
        out = original(self, cluster, terms, weights)
        assert out.max(initial=0) <= bounds[cluster, next(k for k in range(len(items)) if asked.terms[asked.starts[k] : asked.starts[k + 1]] is terms or (asked.terms[asked.starts[k] : asked.starts[k + 1]].tolist() == terms.tolist()))]
        return out

    monkeypatch.setattr(ls.Shard, "scores", counted)
    list(ls.visit(shard, asked, {}, 5))
    assert count[0] < 0.6 * (bounds > 0).sum()


def test_bisection_gathers_what_is_alike():
    rng = np.random.default_rng(3)
    topics = rng.integers(0, 8, 1024)
    lists = [np.unique(np.concatenate((rng.integers(0, 40, 4), 40 + topics[k] * 60 + rng.integers(0, 60, 12)))) for k in range(1024)]
    indptr = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    clusters = ls.bisected(indptr, np.concatenate(lists), np.arange(1024), 600, 64)
    assert sorted(np.concatenate(clusters).tolist()) == list(range(1024)) and max(map(len, clusters)) <= 64
    purity = sum(np.bincount(topics[c]).max() for c in clusters) / 1024
    assert purity > 0.8  # 0.2 in the order given


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(ls, "term_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    v = ls.Vocabulary(["ab", "cd", "abc"])
    data = np.frombuffer(b"abcdab abc zz", np.uint8)
    places, terms = v.find(data, np.array([0, 2, 4, 7, 11]), np.array([2, 4, 6, 10, 13]))
    assert sorted(zip(places.tolist(), terms.tolist())) == [(0, 0), (1, 1), (2, 0), (3, 2)]
