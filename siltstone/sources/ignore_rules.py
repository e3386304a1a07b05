"""Ignore rules: ordered patterns in the folders of a tree, of which the last that matches decides, from the deepest folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.complexity import lines_of


def pattern_regex(pattern: str) -> str:
    """A pattern as a regular expression over paths below its folder; one with a slash holds at the folder only."""
    anchored = "/" in pattern
    body, out, at = pattern.removeprefix("/"), "", 0
    while at < len(body):
        c = body[at]
        if body.startswith("**/", at) and (at == 0 or body[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif body.startswith("/**", at) and at + 3 == len(body):
            out, at = out + "/.+", at + 3
        elif c == "*":
            while body.startswith("*", at):
                at += 1
            out += "[^/]*"
        elif c == "[" and (end := body.find("]", at + 2)) > 0:
            inside = body[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, at = out + "(?!/)[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            if c == "\\" and at + 1 < len(body):
                at, c = at + 1, body[at + 1]
            out, at = out + ("[^/]" if c == "?" and body[at - 1 : at] != "\\" else c if c.isalnum() or c in "/_-" else "\\" + c), at + 1
    return f"^{out}$" if anchored else f"^(?:.*/)?{out}$"


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """(folder, depth, place, pattern, negated, folder_only, regex) of the ignore files among (path, text)."""

    @F.pandas_udf("string")
    def regex(patterns: pd.Series) -> pd.Series:
        return patterns.map(pattern_regex)

    own = files.where(F.element_at(F.split("path", "/"), -1) == name)
    folder = F.regexp_replace("path", r"(^|/)[^/]*$", "")
    rows = own.select(folder.alias("folder"), F.posexplode(lines_of("text")).alias("place", "line"))
    line = F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")
    rows = rows.withColumn("line", line).where("line <> '' and not startswith(line, '#')")
    negated = F.col("line").startswith("!")
    bare = F.regexp_replace(F.when(negated, F.substring("line", 2, 1 << 20)).otherwise(F.col("line")), r"^\\([#!])", "$1")
    rows = rows.select("folder", "place", negated.alias("negated"), bare.alias("given"))
    rows = rows.select("folder", "place", "negated", F.col("given").endswith("/").alias("folder_only"), F.regexp_replace("given", "/+$", "").alias("pattern")).where("pattern <> ''")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return rows.select("folder", depth.alias("depth"), "place", "pattern", "negated", "folder_only", regex("pattern").alias("regex"))


def verdicts(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored, by) for every path: by is the pattern that decided, if any.

    Each folder on the way to a file, and the file, is judged by the last matching rule, deeper folders' rules being
    later; a file is ignored if one of these is. Rows meet by the folder of a rule, which must be one of the entry's.
    """
    steps = F.split("path", "/")
    upto = lambda k: F.array_join(F.slice(steps, 1, k), "/")
    entries = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(upto(k).alias("entry"), (k < F.size(steps)).alias("is_folder"), k.alias("level")))
    walked = files.select("path").distinct().select("path", F.explode(entries).alias("e")).select("path", "e.*")
    judged = walked.select("entry", "is_folder").distinct()
    parts = F.split("entry", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = judged.select("entry", "is_folder", F.explode(folders).alias("folder")).join(rules, "folder")
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substr("entry", F.length("folder") + 2))
    met = met.where((F.col("is_folder") | ~F.col("folder_only")) & F.rlike(below, F.col("regex")))
    last = met.groupBy("entry", "is_folder").agg(F.max_by(F.struct("negated", "pattern"), F.struct("depth", "place")).alias("r"))
    out = walked.join(last, ["entry", "is_folder"], "left")
    stop = F.when(~F.col("r.negated"), F.struct(F.col("level"), F.col("r.pattern").alias("pattern")))
    # the first folder that is ignored decides; without one the file's own rule stands
    own = F.max(F.when(~F.col("is_folder"), F.col("r.pattern")))
    found = out.groupBy("path").agg(F.min(stop).alias("stop"), own.alias("own"))
    return found.select("path", F.col("stop").isNotNull().alias("ignored"), F.coalesce("stop.pattern", "own").alias("by"))


def list_files(files: DataFrame, rules: DataFrame, max_files: int | None = None) -> DataFrame:
    """(path) of what is not ignored, in order; at most max_files first ones."""
    kept = verdicts(files, rules).where("not ignored").select("path").orderBy("path")
    return kept if max_files is None else kept.limit(max_files)


# Attributes that classify a file.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}


def attribute_rules(text: DataFrame) -> DataFrame:
    """(place, pattern, kind) of the lines of a .gitattributes file (text) that classify."""
    rows = text.select(F.posexplode(lines_of("text")).alias("place", "line")).withColumn("line", F.trim("line", F.lit(" \t"))).where("line <> '' and not startswith(line, '#')")
    flags = F.regexp_extract("line", r"^\S+\s+(.*)$", 1)
    kind = F.coalesce(*(F.when(F.contains(flags, F.lit(k)), v) for k, v in ATTRIBUTES.items()))
    return rows.select("place", F.regexp_extract("line", r"^\S+", 0).alias("pattern"), kind.alias("kind")).where("kind is not null")


def attributed(files: DataFrame, rules: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(path, columns to keep, kind): the first rule that matches, null without one; a suffix after stars, a folder before a slash, else a part of the path.

    Rules are few: they become one ordered condition, so that no row is joined.
    """
    path = F.lower("path")
    found = None
    for rule in rules.orderBy("place").collect():  # configuration: the lines of one file
        pattern = rule["pattern"].lower()
        suffix = pattern.lstrip("*")
        if pattern.startswith("*"):
            hit = path.endswith(suffix) if suffix else F.lit(False)
        else:
            hit = path.startswith(pattern) if pattern.endswith("/") else F.contains(path, F.lit(pattern))
        found = F.when(hit, rule["kind"]) if found is None else found.when(hit, rule["kind"])
    return files.select("path", *(keep or []), (found if found is not None else F.lit(None).cast("string")).alias("kind"))
