"""Run folders: reports written by the executors, with one manifest that holds every file's size and digest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.sinks import ROW, redact

MANIFEST, RECEIPT = "manifest", "receipt"


def lines(report: DataFrame, form: str = "jsonl", title: str = "") -> DataFrame:
    """(value) a report of any size as lines of text: jsonl, tsv or md. Heads are no lines of it, see head()."""
    text = lambda c, bar: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit(bar), F.lit("\\|" if bar == "|" else " ")), F.lit(""))
    if form == "jsonl":
        return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value"))
    if form == "tsv":
        return report.select(F.concat_ws("\t", *(text(c, "\t") for c in report.columns)).alias("value"))
    return report.select(F.concat(F.lit("|"), F.concat_ws("|", *(text(c, "|") for c in report.columns)), F.lit("|")).alias("value"))


def head(report: DataFrame, form: str = "jsonl", title: str = "") -> str:
    """What stands before a report's lines."""
    if form == "jsonl":
        return ""
    if form == "tsv":
        return "\t".join(report.columns)
    marks = "|".join("---:" if t in ("bigint", "int", "double", "float") else "---" for _, t in report.dtypes)
    return "\n".join(([f"# {title}", ""] if title else []) + ["|" + "|".join(report.columns) + "|", f"|{marks}|"])


def tree_lines(nodes: DataFrame) -> DataFrame:
    """(node, value) of path_tree() rows as an indented tree, in order, by the executors."""
    name = F.element_at(F.split("node", "/"), -1)
    value = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int") - 1), name, F.lit(" (lines: "), F.col("lines").cast("string"), F.lit(", tokens: "), F.col("tokens").cast("string"), F.lit(")"))
    return nodes.select("node", value.alias("value")).orderBy("node")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, part, bytes, sha256) of the files below a run folder but the manifest; each file is read by one task.

    Names are taken from Spark's listing, so any store that Spark writes to will do.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_extract("path", r"/([^/]+)/([^/]+)$", 0)
    rows = raw.select(F.regexp_extract(inside, r"^/([^/]+)/", 1).alias("artifact"), F.element_at(F.split("path", "/"), -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.where((F.col("artifact") != MANIFEST) & ~F.col("part").rlike(r"^[._]"))


def write_bundle(path: str, reports: dict[str, DataFrame], args: dict | None = None, form: str = "jsonl", mode: str = "run", most_rows: int = 1_000_000) -> DataFrame:
    """Writes every report as a folder of text files, a receipt, and the manifest; gives the manifest.

    A file holds at most most_rows rows. Spark commits what a task wrote only when it ends, so an aborted one leaves
    nothing that the manifest could list; the manifest is written last, so a folder without one is not whole. An
    existing folder is an error.
    """
    spark = next(iter(reports.values())).sparkSession
    names = sorted(reports)
    if not names or {MANIFEST, RECEIPT} & set(names):
        raise ValueError("reports need names other than manifest and receipt")
    path = path.rstrip("/")
    for name in names:
        lines(reports[name], form).write.option("maxRecordsPerFile", most_rows).text(f"{path}/{name}")
    receipt = {"schema_version": 2, "tool": {"name": "siltstone"}, "mode": mode, "args": args or {}, "reports": {n: {"columns": reports[n].columns, "head": head(reports[n], form, n)} for n in names}}
    spark.createDataFrame([(json.dumps(receipt, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/{RECEIPT}")
    digests = file_digests(spark, path)
    digests.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).sortWithinPartitions("value").write.text(f"{path}/{MANIFEST}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("artifact string, part string, bytes long, sha256 string").json(f"{path.rstrip('/')}/{MANIFEST}")


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, part, state) of every file that is missing, changed or unlisted; none if the folder is whole."""
    told, found = read_manifest(spark, path).alias("t"), file_digests(spark, path).alias("f")
    both = told.join(found, (F.col("t.artifact") == F.col("f.artifact")) & (F.col("t.part") == F.col("f.part")), "full")
    state = F.when(F.col("f.part").isNull(), "missing").when(F.col("t.part").isNull(), "unlisted").when(F.col("t.sha256") != F.col("f.sha256"), "changed")
    return both.select(F.coalesce("t.artifact", "f.artifact").alias("artifact"), F.coalesce("t.part", "f.part").alias("part"), state.alias("state")).where("state is not null")


def write_export(rows: DataFrame, path: str, mode: str = "none") -> DataFrame:
    """File rows as a bundle of JSON lines with type = row, redacted as asked."""
    typed = redact(rows, mode).select(F.lit("row").alias("type"), *ROW)
    return write_bundle(path, {"export": typed}, {"redact": mode}, mode="export")
