"""Helpers that several operators of this subpackage use: shared storage and byte views of text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session has an own one (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/siltstone-checkpoints"
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SORTED = "spark.sql.execution.replaceHashWithSortAgg"


@contextmanager
def with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def shuffles_dropped(spark: SparkSession):
    """While a table is written, have Spark remove that write's shuffle files when it ends: nothing reads them again."""
    return with_conf(spark, CLEANUP, "true")


def small_batches(spark: SparkSession):
    """While a table is written, hand texts to Python 2000 rows at a time, so that a worker holds few of them."""
    return with_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def merging_sorted(spark: SparkSession):
    """Have Spark aggregate what is sorted already in that order, instead of hashing it."""
    return with_conf(spark, SORTED, "true")


#: Paths and tables made inside scratch(), to be removed at its end.
_made: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("made", default=None)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append((path, None))
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, parts: int, columns: list[str], tag: str) -> DataFrame:
    """The same, in `parts` buckets by these columns; df is already dealt by them into so many partitions, so each writes one file."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if (made := _made.get()) is not None:
        made.append((path, name))
    if parts > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(parts))
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(parts, *columns).format("parquet").saveAsTable(name)
    return spark.table(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables made within are removed at the end; the function it gives writes what stays.

    An operator whose intermediate tables hold text ends with its result written, so that these need not stay.
    """
    token = _made.set([])

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made = _made.get()
        _made.set(None)
        try:
            return written(df, tag)
        finally:
            _made.set(made)

    try:
        yield keep
    finally:
        made = _made.get()
        _made.reset(token)
        for path, table in made:
            if table is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A written table of short rows, marked for broadcast only if it is counted to have at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text column's UTF-8 bytes end to end, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
