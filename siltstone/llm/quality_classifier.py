"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, thresholded per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kneser_ney import DEVIATION_BIN, MOST_ENTRIES, Scorer, bounds_at, deviation, fit, joined_surprise, n_grams, quantiles
from siltstone.llm.shared import if_small, pieces, small_batches, text_bytes, written


def good_ids(labels: DataFrame, id_col: str) -> DataFrame:
    """(id) labelled as of good quality and never as bad or toxic."""
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t")).where("q = 1 and t = 0")
    return good.where("id is not null").select("id")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tail: float = 0.01, most_trusted: int = 200_000, most_entries: int = MOST_ENTRIES, key_col: str | None = None
) -> DataFrame:
    """One row per document: id_col, lang, log2_perplexity, lower_limit, upper_limit, trusted, kept, and key_col as given.

    The model is fitted on the whole texts of half of the documents labelled as good (chosen by the hash of their ids), up
    to most_trusted of them: a bound on the labelled sample that also lets their ids be broadcast, so that no text is
    shuffled. A language's limits are the quantiles `tail` and 1 - `tail` of the deviation (see there) of all its documents labelled as good that the
    model was not fitted on, since it knows those too well; a document outside them is rejected. Blank texts
    (no word in them), empty and null ones are rejected. A language without good
    documents takes the limits of all good documents together; without any good document all are kept.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"), (F.col(key_col) if key_col else F.lit(None).cast("binary")).alias("key"))
    good = written(good_ids(labels, id_col), "good")
    half = good.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(2)) == 0)
    trusted = written(half.orderBy(F.xxhash64("id"), "id").limit(most_trusted), "trusted")
    model = fit(named.join(F.broadcast(trusted), "id", "left_semi"), "text", most_entries)
    kind, key_kind = named.schema["id"].dataType.simpleString(), named.schema["key"].dataType.simpleString()
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if model.small:
        arrays = spark.sparkContext.broadcast(model.arrays)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(arrays.value)
            for batch in batches:
                data, offsets = text_bytes(batch.column(2))
                sums = [scorer(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, 1 << 21)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(np.concatenate([np.zeros(0), *sums])), pa.array(n_grams(data, offsets))], ["id", "lang", "key", "blank", "surprise", "n_grams"])

        scored = named.select("id", "lang", "text", "key", blank.alias("blank")).mapInArrow(run, f"id {kind}, lang string, key {key_kind}, blank boolean, surprise double, n_grams long")
    else:
        keyed = named.select("id", "lang", "key", blank.alias("blank"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
        scored = keyed.drop("text").join(joined_surprise(keyed.select("name", "text"), model), "name").drop("name")
    flagged = scored.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    # scores are short rows; the good ids may be many, so they are joined as they come
    flagged = flagged.join(good.withColumn("good", F.lit(True)), "id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    with small_batches(spark):
        scored = written(flagged, "scores")
    known = scored.where("good and not trusted and n_grams > 0").withColumn("mean", F.col("surprise") / F.col("n_grams"))
    everyone = known.withColumn("lang", F.lit("*"))
    centres = quantiles(known.unionByName(everyone), "lang", "mean", [0.5]).select("lang", F.col("q")[0].alias("centre"))
    languages = scored.select("lang").distinct()

    def per_language(table: DataFrame, columns: list[str]) -> DataFrame:
        """Rows for every language of the documents, those of all together where it has none of its own."""
        common = table.where("lang = '*'").select(*(F.col(c).alias(f"all_{c}") for c in columns))
        own = languages.join(table, "lang", "left")
        return own.join(F.broadcast(common), F.lit(True), "left").select("lang", *(F.coalesce(c, f"all_{c}").alias(c) for c in columns))  # one row

    centres = written(per_language(centres, ["centre"]), "centres")
    valued = scored.join(if_small(centres), "lang", "left").withColumn("deviation", deviation(F.col("surprise"), F.col("n_grams"), F.col("centre")))
    sure = valued.where("good and not trusted")
    limits = quantiles(sure.unionByName(sure.withColumn("lang", F.lit("*"))), "lang", "deviation", [tail, 1 - tail], DEVIATION_BIN).select(
        "lang", F.col("q")[0].alias("lower"), (F.col("q")[1] + DEVIATION_BIN).alias("upper")
    )
    limits = if_small(written(per_language(limits, ["lower", "upper"]), "limits"))
    inside = F.coalesce(F.col("deviation").between(F.col("lower"), F.col("upper")), F.lit(True))
    at = [bounds_at(F.col(side), F.col("n_grams"), F.col("centre")).alias(f"{side}_limit") for side in ("lower", "upper")]
    return valued.join(limits, "lang", "left").select(
        F.col("id").alias(id_col), *([F.col("key").alias(key_col)] if key_col else []), "lang", F.try_divide("surprise", "n_grams").alias("log2_perplexity"), *at, "trusted", (inside & ~F.col("blank")).alias("kept")
    )
