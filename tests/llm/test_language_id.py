"""op12: words, scores and paths against plain restatements, held-out accuracy, scripts, mixed texts and odd rows."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import language_id as li

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, spans string, id string"
SYLLABLES = {"aa": "ba lo mi ter and", "bb": "zu kre scho in ung", "cc": "дом ля при ов ст", "dd": "жы це шо ов та"}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 5))) for _ in range(n)) + "."


def rows_of(rng):
    rows = [(k, text_of(rng, lang, rng.randrange(5, 60)), lang, None, None, None) for k, lang in enumerate(["aa", "bb", "cc", "dd"] * 40)]
    return rows + [(900, None, "aa", None, None, None), (901, "", "bb", None, None, None), (902, "12 %% ́", None, None, None, None), (903, "漢字 日本", None, None, None, None), (None, text_of(rng, "cc", 9), None, None, None, None)]


def plain_path(scores, penalty):
    """The best path's sum by the plain recursion."""
    best = list(scores[0])
    for row in scores[1:]:
        best = [max(b if i == j else b - penalty for i, b in enumerate(best)) + x for j, x in enumerate(row)]
    return max(best)


def test_paths_are_best():
    rng = np.random.default_rng(1)
    for wide in (5, 40, 400):
        rows = np.sort(rng.integers(0, 60, 3000))
        scores = rng.integers(-wide, wide, (3000, 3)).astype(np.int32)
        scores[rng.random(3000) < 0.02] *= 9
        labels = li.viterbi(scores, rows, 30)
        for r in np.unique(rows):
            at = np.flatnonzero(rows == r)
            own = labels[at]
            assert scores[at, own].sum() - 30 * (own[1:] != own[:-1]).sum() == plain_path(scores[at].tolist(), 30)


def test_words_and_trigram_counts():
    texts = ["Ab cd", "", "é́x—Ÿ 9a", "́ ", "x"]
    data = [t.encode() for t in texts]
    w = li.words_of(b"".join(data), np.concatenate(([0], np.cumsum([len(b) for b in data]))), 18)
    got = [(int(r), "".join(map(chr, w.codes[a:b]))) for r, a, b in zip(w.rows, w.starts, w.ends)]
    assert got == [(0, "Ab"), (0, "cd"), (2, "é́x"), (2, "Ÿ"), (2, "a"), (4, "x")]
    assert w.letters.tolist() == [2, 2, 2, 1, 1, 1]
    assert len(w.grams) == sum(b - a + 1 for a, b in zip(w.starts, w.ends))
    assert w.grams[w.gram_starts[4]] == li.words_of(b"A", np.array([0, 1]), 18).grams[0]


def test_held_out_accuracy_scripts_and_odd_rows(spark):
    rng = random.Random(2)
    rows = rows_of(rng)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in li.language_report(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, lang, *_ in rows:
        if doc is not None:
            assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
        if lang is not None and text:
            assert got[doc]["lang_pred"] == lang
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert (got[doc]["lang_pred"], got[doc]["score"], got[doc]["n_spans"]) == ("und", 0.0, 0)
    assert got[903]["lang_pred"] in SYLLABLES and got[903]["score"] == 0.0
    assert got[None]["lang_pred"] == "cc"
    assert li.language_report(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in li.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_counts_of_the_model(spark):
    docs = spark.createDataFrame(rows_of(random.Random(3)), SCHEMA).repartition(5)
    model = li.train(docs)
    plain = {lang: Counter() for lang in SYLLABLES}
    for r in docs.where("lang is not null and text is not null").collect():
        data = r["text"].encode()
        plain[r["lang"]].update(li.words_of(data, np.array([0, len(data)]), model.bits).grams.tolist())
    for k, lang in enumerate(model.languages):
        total = sum(plain[lang].values())
        for bucket, n in plain[lang].items():
            assert model.scores[bucket, k] == round(math.log(n / total + li.FLOOR) * li.UNIT)
    latin, cyrillic = (li.SCRIPTS.index(x) for x in ("latin", "cyrillic"))
    assert {lang for k, lang in enumerate(model.languages) if model.written[latin, k]} == {"aa", "bb"}
    assert {lang for k, lang in enumerate(model.languages) if model.written[cyrillic, k]} == {"cc", "dd"}


def test_spans_of_mixed_texts(spark):
    rng = random.Random(4)
    model = li.train(spark.createDataFrame(rows_of(rng), SCHEMA))
    parts = [(lang, text_of(rng, lang, 12)) for lang in ("aa", "cc", "bb")]
    mixed = spark.createDataFrame([(1, " ".join(t for _, t in parts))], "doc_id long, text string")
    row = li.identify(mixed, model).collect()[0]
    assert [s["lang"] for s in row["spans"]] == ["aa", "cc", "bb"]
    text = " ".join(t for _, t in parts)
    for s, (_, part) in zip(row["spans"], parts):
        assert text[s["first_char"] : s["first_char"] + s["n_chars"]] == part[:-1]
    assert 0 < row["score"] < 1


def test_whole_table_and_a_very_long_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = li.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert right >= 0.99 * n
    model = li.train(docs)
    long = docs.where("lang = 'de'").agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).select(F.lit(1).alias("doc_id"), F.repeat("t", 12).alias("text"))
    row = li.identify(long, model).collect()[0]
    assert row["lang_pred"] == "de" and row["n_letters"] > 3_000_000
