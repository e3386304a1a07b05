"""Line reports of any size in segments: what a line needs from the lines before it is carried from segment to segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, chunk, n, line) of text files; Spark cuts a large file into splits, and each split is a segment.

    A segment's lines are numbered in the order in which its task reads them.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return raw.select(F.col("file_path").alias("name"), F.col("file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def cut_lines(texts: DataFrame, name: str, text: str = "text", chunk_lines: int = 65_536) -> DataFrame:
    """The same of texts in rows, in segments of so many lines."""
    lines = texts.select(F.col(name).alias("name"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    return lines.select("name", F.floor(F.col("n") / chunk_lines).alias("chunk"), F.col("n").cast("long").alias("n"), "line")


def scanned(lines: DataFrame, last: dict[str, Column] | None = None, count: dict[str, Column] | None = None) -> DataFrame:
    """Adds to each line, under each name in `last`, the value that was not null last at or before it, and in `count` how often a condition held by then.

    First each segment is summed up to one row; a window over those rows gives what each segment begins with; then
    every segment is scanned on its own. No task orders more than a segment's lines or a file's segments.
    """
    last, count = last or {}, count or {}
    keys = ["name", "chunk"]
    summed = lines.groupBy(*keys).agg(
        *(F.max_by(v, F.when(v.isNotNull(), F.col("n"))).alias(k) for k, v in last.items()), *(F.sum(v.cast("long")).alias(k) for k, v in count.items())
    )
    before = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = summed.select(
        F.col("name").alias("_name"), F.col("chunk").alias("_chunk"),
        *(F.last(k, ignorenulls=True).over(before).alias(f"_{k}") for k in last), *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in count),
    )
    here = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lines.select("*", *(F.last(v, ignorenulls=True).over(here).alias(f"own_{k}") for k, v in last.items()), *(F.sum(v.cast("long")).over(here).alias(f"own_{k}") for k, v in count.items()))
    met = own.join(begun, F.col("name").eqNullSafe(F.col("_name")) & (F.col("chunk") == F.col("_chunk")), "left")
    return met.select(*lines.columns, *(F.coalesce(f"own_{k}", f"_{k}").alias(k) for k in last), *((F.col(f"own_{k}") + F.col(f"_{k}")).alias(k) for k in count))
