"""The corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing; each stage written and reread.

A stage's verdicts are joined back by a digest of the whole row, so rows without a doc_id and rows that share one are
judged one by one. Rows equal in every column are one row to the dedup stages; the others keep them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.exact_dedup import exact_dedup
from siltstone.llm.mixing import mix_sources
from siltstone.llm.near_copies import near_copies
from siltstone.llm.packing import pack_documents
from siltstone.llm.quality_classifier import quality_scores
from siltstone.llm.shared import documents, written


def row_digest(docs: DataFrame) -> Column:
    """A digest of all columns of a row; a null differs from any value."""
    values = (F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in docs.columns)
    return F.unhex(F.sha2(F.concat_ws("\x00", *values), 256))


def rows_of(docs: DataFrame, keys: DataFrame, once: bool) -> DataFrame:
    """The rows of docs whose digests are among the keys; once: of rows that repeat in every column, one."""
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_digest(docs).alias("key"))
    found = marked.join(keys, "key", "left_semi")
    if once and not keys.groupBy("key").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["key"])
    return found.select("row.*")


def ranked(docs: DataFrame, nulls_last: bool) -> DataFrame:
    """(id, text): the doc_id with the row's digest behind it, which orders rows of one doc_id; and where rows without one stand."""
    missing = F.col("doc_id").isNull()
    return docs.select(F.struct((missing if nulls_last else ~missing).alias("place"), "doc_id", row_digest(docs).alias("key")).alias("id"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier does not reject. A row without a doc_id is scored like any other."""
    keyed = docs.select("doc_id", "text", "lang", row_digest(docs).alias("key"))
    scores = quality_scores(keyed, documents(spark, sf_dir, "labels"), key_col="key")
    return rows_of(docs, scores.where("kept").select("key"), False)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, one without any last; of rows of one doc_id, that of the largest digest."""
    kept = exact_dedup(ranked(docs, False), "id").where("kept").select("id.key")
    return rows_of(docs, written(kept, "exact-kept"), True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity 0.8 or more), the row with the smallest doc_id, one without any last."""
    kept = near_copies(ranked(docs, True), "id").where("id <=> component_id").select("id.key")
    return rows_of(docs, written(kept, "near-kept"), True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources again up to the mixture's weights."""
    return mix_sources(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Tokenizing and the model have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
