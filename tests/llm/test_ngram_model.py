"""The n-gram model against a plain restatement of modified Kneser-Ney smoothing, and both ways of scoring against each other."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import kneser_ney, quality_classifier, quality_rules

N = kneser_ney.ORDER
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def padded(unit):
    return " " * (N - 3) + unit + " "


def units(text):
    """Words after a space and the ASCII mark, if any, that ends the word before; a line feed stands for a text's start."""
    before = "\n"
    for w in WORD.findall(text or ""):
        yield f"{before} {w}"
        before = w[-1] if ord(w[-1]) < 128 and not w[-1].isalnum() else " "


class ByHand:
    def __init__(self, texts, once=False):
        top = Counter()
        for t in texts:
            for w in set(units(t)) if once else units(t):
                p = padded(w)
                top.update(p[i : i + N] for i in range(len(p) - N + 1))
        self.counts = {N: top}
        for n in range(N - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discounts, self.total, self.kinds = {}, {}, {}
        for n, counts in self.counts.items():
            of = Counter(counts.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0.5
            self.discounts[n] = [0.0] + [min(max(k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k, 0.05 * k), k) for k in (1, 2, 3)]
            self.total[n], self.kinds[n] = Counter(), defaultdict(Counter)
            for g, c in counts.items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]][min(c, 3)] += 1

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / (len(self.counts[1]) + 1)
        lower, context = self.p(gram[1:]), gram[:-1]
        total = self.total[n][context]
        if not total:
            return lower
        d, c = self.discounts[n], self.counts[n][gram]
        freed = sum(d[k] * m for k, m in self.kinds[n][context].items())
        return (c - d[min(c, 3)] if c else 0.0) / total + freed / total * lower

    def surprise(self, text):
        total = n = 0
        for w in units(text):
            p = padded(w)
            for i in range(len(p) - N + 1):
                total -= math.log2(self.p(p[i : i + N]))
                n += 1
        return total, n


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    syllables = ["an", "er", "th", "ing", "на", "ло", "春", "江花月", "é", "ß"]
    made = [" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    return made + ["", None, " \n", made[3], made[3], "x" * 5000, "春江潮水连海平海上明月共潮生" * 50, "a\x1cb\x85c d", "One, two. Three! (four) `five` 6. \x1c. 7\x0b8"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, random.Random(k).choice(["en", "ru", None])) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"gram": F.lit("x"), "name": F.lit("y"), "n": F.lit(1)}).repartition(3)


@pytest.fixture(scope="module")
def by_hand(texts):
    return ByHand(texts)


def test_counts(docs, texts, by_hand):
    assert {r["gram"]: r["n"] for r in kneser_ney.count_ngrams(docs, once=True).collect()} == ByHand(texts, once=True).counts[N]
    for limits in ({}, {"most_words": 3, "most_grams": 5}):
        assert {r["gram"]: r["n"] for r in kneser_ney.count_ngrams(docs, **limits).collect()} == by_hand.counts[N]


def test_shares_are_those_of_the_smoothing(docs, by_hand):
    arrays = kneser_ney.fit(docs).arrays
    words = ["aning", "наth", "zzz", "春江", "é", "thththth", "明月"]
    points, at, n = kneser_ney.padded(words)
    expected = [by_hand.p(padded("  " + w)[i : i + N]) for w in words for i in range(len(w) + 1)]
    assert arrays.shares(points, at) == pytest.approx(expected, rel=1e-9) and n.tolist() == [len(w) + 1 for w in words]


def test_shares_add_up_to_one(docs, by_hand):
    arrays = kneser_ney.fit(docs).arrays
    symbols = sorted(by_hand.counts[1]) + ["\U0010ffff"]
    for context in (x.rjust(N - 1)[1 - N :] for x in ("ane", "zzzz", "  a", "春江花月", "")):
        points = np.array([ord(c) for s in symbols for c in context + s], np.uint32)
        assert arrays.shares(points, np.arange(len(symbols)) * N).sum() == pytest.approx(1.0)


def scores(df):
    return {r["doc_id"]: (r["log2_perplexity"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("most_entries", [kneser_ney.MOST_ENTRIES, 0], ids=["sorted arrays", "joins"])
def test_both_ways_of_scoring(docs, texts, most_entries):
    by_hand = ByHand(texts, once=True)
    got = quality_rules.quality_rules(docs, tails=(0.05, 0.05), most_entries=most_entries).collect()
    expected = {k: by_hand.surprise(t) for k, t in enumerate(texts)}
    means, deviations = defaultdict(list), defaultdict(list)
    passing = [(r["doc_id"], r["lang"]) for r in got if not r["base_failed"] and expected[r["doc_id"]][1]]

    def rank(values, q):
        return sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]

    for k, lang in passing:
        means[lang].append(expected[k][0] / expected[k][1])
    centre = {lang: math.floor(rank(v, 0.5) / kneser_ney.BIN) * kneser_ney.BIN for lang, v in means.items()}
    for k, lang in passing:
        total, n = expected[k]
        deviations[lang].append((total - n * centre[lang]) / math.sqrt(n))
    for r in got:
        total, n = expected[r["doc_id"]]
        if not n:
            assert not r["kept"] and r["log2_perplexity"] is None
            continue
        # quantiles are read at a resolution
        low, high = (centre[r["lang"]] + rank(deviations[r["lang"]], q) / math.sqrt(n) for q in (0.05, 0.95))
        slack = 2 * kneser_ney.DEVIATION_BIN / math.sqrt(n) + 1e-5
        assert r["log2_perplexity"] == pytest.approx(total / n, abs=1e-5)
        assert r["lower_band"] == pytest.approx(low, abs=slack) and r["upper_band"] == pytest.approx(high, abs=slack)
        if min(abs(total / n - r["lower_band"]), abs(total / n - r["upper_band"])) > 1e-4:
            assert r["kept"] == (not r["base_failed"] and r["lower_band"] <= total / n <= r["upper_band"])


def test_classifier_has_one_result_either_way(spark, docs):
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(0, 160, 2)], "doc_id long, quality int, toxic int")
    small = scores(quality_classifier.quality_scores(docs, labels))
    joined = scores(quality_classifier.quality_scores(docs, labels, most_entries=0))
    assert small.keys() == joined.keys()
    for k, (value, kept) in small.items():
        assert joined[k][1] == kept and (value is None and joined[k][0] is None or joined[k][0] == pytest.approx(value, abs=1e-5))


def test_texts_without_ascii_differ(spark):
    good = "春江潮水连海平海上明月共潮生滟滟随波千万里何处春江无月明"
    rows = [(k, " ".join(good[j : j + 7] for j in range(k % 9, 20, 2)), "zh") for k in range(60)]
    rows += [(100, "春江潮水连海平 海上明月共潮生", "zh"), (101, "平潮江水春连海 生明潮月海共上", "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = scores(quality_classifier.quality_scores(docs, labels))
    assert got[101][0] > got[100][0] + 1


def test_sums_are_whole_numbers(docs):
    """A text of over 32 MB has its words' sum, and rows of any order the same sums."""
    arrays = kneser_ney.fit(docs).arrays

    def score(texts, **most):
        return kneser_ney.Scorer(arrays, **most)(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))

    once = b"The sea was calm and the old men sat by the harbour wall. "
    one, two, many = score([once, once * 2, once * 600_000])
    assert many == pytest.approx(one + (two - one) * 599_999, abs=1e-3)
    rng = random.Random(4)
    texts = [b" ".join(bytes(rng.choices(b"abcdefgh.,", k=rng.randrange(1, 9))) for _ in range(rng.choice([0, 1, 3, 50, 300]))) for _ in range(500)]
    order = rng.sample(range(len(texts)), len(texts))
    assert (score(texts)[order] == score([texts[k] for k in order], most=50)).all()


def test_n_grams(texts):
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    expected = [sum(len(w) + 1 for w in WORD.findall(t or "")) for t in texts]
    assert kneser_ney.n_grams(np.frombuffer(b"".join(data), np.uint8), offsets).tolist() == expected
