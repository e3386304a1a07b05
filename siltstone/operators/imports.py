"""Import statements of source files: targets per line, with Go's import block carried from line to line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.complexity import by_lang, lines_of, trim

#: Only so many first lines of a file are read for imports.
MOST_LINES = 200
STRINGS = "array<string>"


def quoted(line: Column) -> Column:
    """What stands between the first quote of a line and the next of its kind, or the end; null if nothing does."""
    found = F.concat(F.regexp_extract(line, r"""^[^"']*"([^"]*)""", 1), F.regexp_extract(line, r"""^[^"']*'([^']*)""", 1))
    return F.nullif(found, F.lit(""))


def after(line: Column, mark: str) -> Column:
    return F.substr(line, F.lit(len(mark) + 1))


def rust(lines: Column) -> Column:
    """The first step of what `use` names, and what `mod` names."""
    bare = lambda x: trim(F.regexp_replace(x, ";+$", ""))
    return F.transform(lines, lambda x: F.when(x.startswith("use "), F.split(bare(after(x, "use ")), "::", 2)[0]).when(x.startswith("mod "), bare(after(x, "mod "))))


def script(lines: Column) -> Column:
    required = lambda x: F.when(F.contains(x, F.lit("require(")), quoted(F.regexp_replace(x, r"^.*?require\(", "")))
    return F.flatten(F.transform(lines, lambda x: F.array(F.when(x.startswith("import "), quoted(x)), required(x))))


def python(lines: Column) -> Column:
    word = lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)
    return F.transform(lines, lambda x: F.when(x.startswith("import "), word(after(x, "import "))).when(x.startswith("from "), word(after(x, "from "))))


def go(lines: Column) -> Column:
    """A fold with the state whether an `import (` is open; its list holds no more than the lines read."""

    def step(s: Column, x: Column) -> Column:
        opens, closes = x.startswith("import ("), s["open"] & x.startswith(")")
        target = F.when(~opens & ~closes & (s["open"] | x.startswith("import ")), quoted(x))
        return F.struct((opens | (s["open"] & ~closes)).alias("open"), F.when(target.isNull(), s["found"]).otherwise(F.array_append(s["found"], target)).alias("found"))

    return F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.array().cast(STRINGS).alias("found")), step, lambda s: s["found"])


def normalized(target: Column) -> Column:
    """The root that is depended on: `local` for relative targets, else up to the first slash, colon or dot."""
    bare = trim(target)
    return F.when(bare.startswith("."), F.lit("local")).otherwise(F.split(F.regexp_replace(F.regexp_replace(bare, '^"+|"+$', ""), "^'+|'+$", ""), "[/:.]", 2)[0])


def imports(contents: DataFrame) -> DataFrame:
    """(path, module, lang, target) for every import statement of files in five languages, targets as they stand."""
    lang = F.lower("lang")
    lines = F.transform(F.slice(lines_of("text"), 1, MOST_LINES), trim)
    known = {"rust": rust(lines), "javascript": script(lines), "typescript": script(lines), "python": python(lines), "go": go(lines)}
    rows = contents.where(lang.isin(list(known)) & F.col("text").isNotNull())
    found = rows.select("path", "module", lang.alias("lang"), F.explode(by_lang(lang, known, F.array().cast(STRINGS))).alias("target"))
    return found.where("target is not null")


def import_edges(contents: DataFrame, granularity: str = "module") -> DataFrame:
    """(source, target, count): source is the module or the file, target is normalized."""
    source = {"module": "module", "file": "path"}[granularity]
    edges = imports(contents).select(F.col(source).alias("source"), normalized(F.col("target")).alias("target"))
    return edges.groupBy("source", "target").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "source", "target")
