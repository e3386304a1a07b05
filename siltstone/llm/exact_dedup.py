"""Exact dedup as a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import ascii_lower, merging_sorted, written

KEY = ["digest", "sha", "n_bytes"]
#: A run is cut at these leading bits of the digest, so that one run's ranges are merged by many tasks.
RANGE_BITS = 12


def digest_runs(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One row a document: a short digest to sort by, a SHA-256 and length to verify it, and the run (its partition's)."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("digest"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        (F.spark_partition_id() % runs).alias("run"),
    )


def tree_merge(digests: DataFrame, keep: str, runs: int) -> DataFrame:
    """Merge the runs in binomial rounds until one is left: (digest, sha, n_bytes, keep_id, group_size).

    In round r each run whose number has bit r set goes to the one without it. Both are sorted by (range, digest,
    verifying columns); what meets is sorted and aggregated in that order, so of each verified group one row with its
    kept identifier goes on: equal short digests of different texts never merge, and a group of copies of any size adds
    at most one row per run to a round. Each round's runs are written, so a lost executor costs one round at most.
    """
    pick = {"largest": F.max, "smallest": F.min}[keep]
    order = ["range", "run", *KEY]
    sizes = F.sum("group_size").alias("group_size")

    def met(level: DataFrame) -> DataFrame:
        """Runs that meet, merged in the common order; the kept identifier of each group goes on, whatever order its rows have.

        The first row's identifier stands in the plan because Spark drops a sort that no aggregate looks at.
        """
        together = level.repartition("range", "run").sortWithinPartitions(*order)
        return together.groupBy(*order).agg(F.coalesce(pick("keep_id"), F.first("keep_id")).alias("keep_id"), sizes)

    ranged = F.shiftrightunsigned("digest", 64 - RANGE_BITS).cast("int").alias("range")
    level = digests.select(ranged, "run", *KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    with merging_sorted(digests.sparkSession):
        # within a partition's run copies are combined before anything is sent
        level = written(level.groupBy(*order).agg(pick("keep_id").alias("keep_id"), sizes).sortWithinPartitions(*order), "runs")
        for bit in range((runs - 1).bit_length()):
            level = written(met(level.withColumn("run", F.col("run").bitwiseAND(F.lit(~(1 << bit))))), "runs")
    return level.drop("run", "range")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 64) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. A repeated id in one group is kept
    wherever it equals keep_id; null ids lose to any other id. An empty table gives an empty result. Other columns of
    the input are ignored, whatever their names.
    """
    digests = written(digest_runs(docs, id_col, text_col, runs), "digests")
    merged = tree_merge(digests, keep, runs)
    return digests.drop("run").join(merged, KEY).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
