"""Rates of junk and good documents that pass the perplexity fences, on the labels of sf0.1."""

from pyspark.sql import functions as F

from siltstone.llm import quality_classifier, quality_rules

AT = "/root/testdata/sf0.1"


def rates(scored, labels):
    kept = F.avg(F.col("kept").cast("double"))
    rows = scored.join(labels, "doc_id").groupBy("quality", F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(kept.alias("k"), F.count("*").alias("n")).collect()
    junk = [(r["k"], r["n"]) for r in rows if r["quality"] == 0]
    return sum(k * n for k, n in junk) / sum(n for _, n in junk), {r["toxic"]: r["k"] for r in rows if r["quality"] == 1}


def test_rules_reject_junk(spark):
    docs, labels = spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet")
    junk, good = rates(quality_rules.quality_rules(docs), labels)
    print("op4 junk kept", junk, "quality 1 kept by toxic", good)
    assert junk < 0.1 and good[0] > 0.94


def test_classifier_rejects_held_out_junk(spark):
    docs, labels = spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet")
    scored = quality_classifier.quality_scores(docs, labels.where("doc_id % 2 = 0"))
    junk, good = rates(scored, labels.where("doc_id % 2 = 1"))
    print("op9 held-out junk kept", junk, "quality 1 kept by toxic", good)
    assert junk < 0.06 and good[0] > 0.97 and good[1] < 0.6


def test_limits_are_of_all_good_documents(spark):
    """Fitted on a few documents only, the limits still cover all others that are labelled good."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_classifier.quality_scores(docs, labels, most_trusted=20)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    found = scored.join(good, "doc_id").agg(F.sum(F.col("trusted").cast("int")), F.avg(F.col("kept").cast("double"))).first()
    assert found[0] == 20 and found[1] > 0.93
