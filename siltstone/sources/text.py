"""Readers that make fact tables from files: source trees, zip archives, history logs, diffs, coverage and receipts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import module_key, normalize_path
from siltstone.sources.line_scanner import scan_rows
from siltstone.sources.segments import cut_lines, scanned

# Languages by file extension and by whole name.
LANGS = {
    "c": "C", "cc": "C++", "cpp": "C++", "cs": "C#", "css": "CSS", "go": "Go", "h": "C", "hpp": "C++", "html": "HTML", "java": "Java", "js": "JavaScript", "json": "JSON", "jsx": "JavaScript", "kt": "Kotlin", "md": "Markdown",
    "php": "PHP", "py": "Python", "rb": "Ruby", "rs": "Rust", "sh": "Shell", "sql": "SQL", "swift": "Swift", "toml": "TOML", "ts": "TypeScript", "tsx": "TypeScript", "txt": "Text", "xml": "XML", "yaml": "YAML", "yml": "YAML",
}
NAMES = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "CMakeLists.txt": "CMake"}
SHEBANGS = {"bash": "Shell", "node": "JavaScript", "perl": "Perl", "python": "Python", "ruby": "Ruby", "sh": "Shell"}


def language(path, text):
    """By whole name, then extension, then shebang; null if none fits."""
    name = F.element_at(F.split(path, "/"), -1)
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    tool = F.regexp_extract(text, r"^#!\s*(?:\S*/)?(?:env\s+(?:-S\s+)?)?([a-z]+)", 1)
    return F.coalesce(F.try_element_at(table(NAMES), name), F.try_element_at(table(LANGS), ext), F.try_element_at(table(SHEBANGS), tool))


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of every text file under root; files with NUL bytes or invalid UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    inside = F.regexp_replace("path", r"^.*?" + root.rstrip("/").lstrip("/").replace(".", r"\.") + "/", "")
    return raw.select(inside.alias("path"), F.col("content")).where(F.expr("is_valid_utf8(cast(content as string))")).select("path", F.col("content").cast("string").alias("text")).where(~F.contains("text", F.lit("\0")))


def checked_inputs(inputs: DataFrame) -> DataFrame:
    """In-memory (path, text) inputs without absolute paths, parent steps or paths that are equal but for case."""
    path = normalize_path("path")
    safe = inputs.withColumn("path", path).where(~F.col("path").rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)") & (F.col("path") != ""))
    twice = safe.groupBy(F.lower("path").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    return safe.join(twice, F.lower(safe["path"]) == twice["k"], "left_anti")


def file_rows(contents: DataFrame, roots: list[str], depth: int = 2, children: str = "parents-only", doc_strings: bool = False, exact_bytes: bool = False) -> DataFrame:
    """File rows of (path, text), each line classified by the scanner; files of unknown languages are left out.

    Bytes are estimated as 40 a line, or those of the text with exact_bytes; tokens are a quarter of them.
    """
    rows = contents.withColumn("lang", language(F.col("path"), F.col("text"))).where("lang is not null")
    rows = scan_rows(rows.withColumn("module", module_key("path", roots, depth)), children, doc_strings)
    if exact_bytes:
        return rows
    size = F.when(F.col("kind") == "parent", F.col("lines") * 40).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("bytes", size).withColumn("tokens", F.floor(F.col("bytes") / 4).cast("long"))


def read_zip(archives: DataFrame, entry_bytes: int = 64 << 20, total_bytes: int = 1 << 30, entries: int = 65_536, ratio: float = 100.0) -> DataFrame:
    """(archive, path, text, error) of zip archives given as (path, content); an archive that breaks a limit gives one error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows, error, total = [], None, 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        infos = [i for i in archive.infolist() if not i.is_dir()]
                        if len(infos) > entries:
                            raise ValueError("too many entries")
                        for i in infos:
                            total += i.file_size
                            steps = i.filename.replace("\\", "/").split("/")
                            if i.filename.startswith("/") or ".." in steps or i.external_attr >> 28 == 0xA:
                                raise ValueError(f"unsafe entry {i.filename}")
                            if i.file_size > entry_bytes or total > total_bytes or i.file_size > ratio * max(i.compress_size, 1):
                                raise ValueError(f"entry too large {i.filename}")
                            data = archive.read(i)
                            if b"\0" not in data:
                                rows.append((name, "/".join(steps), data.decode("utf-8", "replace"), None))
                except (ValueError, zipfile.BadZipFile, RuntimeError) as found:
                    rows, error = [], str(found)
                if error is not None:
                    rows = [(name, None, None, error)]
                yield pd.DataFrame(rows, columns=["archive", "path", "text", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, text string, error string")


def lines_of_reports(reports: DataFrame, name: str) -> DataFrame:
    """Lines in segments, as read by read_lines, or cut from texts in rows."""
    return reports if "line" in reports.columns else cut_lines(reports, name)


def parse_history(log: DataFrame, max_commits: int | None = None, max_commit_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) from logs of lines "time|author|hash|subject", each followed by its files.

    log: (repo, text), or lines in segments. Of each log, at most max_commits first commits, and of each commit at most
    max_commit_files first files.
    """
    lines = lines_of_reports(log, "repo").where("line <> ''")
    head = F.col("line").rlike(r"^[0-9]+\|[^|]*\|[0-9a-f]*\|")
    lines = scanned(lines.withColumn("head", head), count={"seq": F.col("head")}).where("seq > 0").withColumnRenamed("name", "repo")
    if max_commits is not None:
        lines = lines.where(F.col("seq") <= max_commits)
    part = F.split("line", r"\|", 4)
    commits = lines.where("head").select("repo", "seq", part[0].cast("long").alias("ts"), part[1].alias("author"), part[2].alias("hash"), part[3].alias("subject"))
    files = lines.where("not head")
    if max_commit_files is not None:
        place = F.row_number().over(Window.partitionBy("repo", "seq").orderBy("chunk", "n"))
        files = files.withColumn("place", place).where(F.col("place") <= max_commit_files)
    return commits, files.select("repo", "seq", F.col("line").alias("path")).distinct()


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(path, insertions, deletions) of tab-separated lines in a column `value`; what is no number counts 0."""
    part = F.split("value", "\t", 3)
    number = lambda k: F.coalesce(F.expr(f"try_cast(split(value, '\\t', 3)[{k}] as bigint)"), F.lit(0).cast("long"))
    return lines.where(F.size(part) == 3).select(part[2].alias("path"), number(0).alias("insertions"), number(1).alias("deletions"))


def parse_added_lines(diffs: DataFrame) -> DataFrame:
    """(path, line) of unified diffs without context, given as (name, text) or as lines in segments."""
    target = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_replace("line", r"^\+\+\+ ", ""), "^b/", ""))
    lines = scanned(lines_of_reports(diffs, "name"), last={"path": target})
    hunk = lines.where(F.col("line").rlike(r"^@@ .* \+[0-9]+") & (F.col("path") != "/dev/null"))
    start = F.regexp_extract("line", r"^@@ \S+ \+([0-9]+)", 1).cast("long")
    count = F.coalesce(F.expr(r"try_cast(regexp_extract(line, '^@@ \\S+ \\+[0-9]+,([0-9]+)', 1) as bigint)"), F.lit(1).cast("long"))
    return hunk.select("path", start.alias("s"), count.alias("c")).where("c > 0").select("path", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("c") - 1)).alias("line")).distinct()


def parse_lcov(reports: DataFrame) -> DataFrame:
    """(path, line, hits) of coverage texts (name, text) or lines in segments; a line given twice keeps its last count; data before a source file is left out."""
    mark = F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20)).when(F.col("line") == "end_of_record", F.lit(""))
    lines = scanned(lines_of_reports(reports, "name"), last={"path": mark}).where("path <> ''")
    data = F.regexp_extract("line", r"^DA:([0-9]+),[0-9]+", 1)
    rows = lines.where(data != "").select("path", data.cast("long").alias("line"), F.regexp_extract("line", r"^DA:[0-9]+,([0-9]+)", 1).cast("long").alias("hits"), F.struct("name", "chunk", "n").alias("at"))
    return rows.groupBy("path", "line").agg(F.max_by("hits", "at").alias("hits"))


def load_export(spark: SparkSession, path: str) -> DataFrame:
    """File rows of a written export (JSON lines with type = row)."""
    schema = "type string, path string, module string, lang string, kind string, code long, comments long, blanks long, lines long, bytes long, tokens long"
    return spark.read.schema(schema).json(path).where("type = 'row'").drop("type")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths: * within a directory, ** across, ? one character."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            c = pattern[at]
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_" else "\\" + c), at + 1
    return f"^(?:{out})(?:/.*)?$"


def exclude(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose path no pattern matches; a pattern without a slash also matches in any directory."""
    for p in patterns:
        p = p.replace("\\", "/").removeprefix("./").strip("/")
        rows = rows.where(~F.col("path").rlike(glob_regex(p if "/" in p else f"**/{p}")))
    return rows
