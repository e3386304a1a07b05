"""Dependencies counted in lockfiles of six kinds, licence files and the licences that manifests declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.complexity import lines_of, trim

# Lockfiles by name.
KINDS = {"Cargo.lock": "cargo", "package-lock.json": "npm", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "go.sum": "go", "Gemfile.lock": "bundler"}
# Manifests that may declare a licence, and how names of licence files begin.
MANIFESTS = ["cargo.toml", "package.json", "pyproject.toml"]
LICENSE_NAMES = ["license", "copying", "notice"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def count_npm(text: Column) -> Column:
    """Keys of `packages`, the root's own empty one not counted, else of `dependencies`; 0 where the text is no JSON.

    A key counts as often as it stands, so the maps are read as they are written: VARIANT takes no text with a key twice.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    whole = F.when(trim(text).startswith("{"), F.from_json(text, "packages map<string,string>, dependencies map<string,string>", strict))
    packages, dependencies = F.map_keys(whole["packages"]), F.map_keys(whole["dependencies"])
    count = F.size(F.filter(packages, lambda k: k != ""))
    return F.coalesce(F.when(packages.isNotNull(), count), F.when(dependencies.isNotNull(), F.size(dependencies)), F.lit(0))


def count_go(lines: Column) -> Column:
    """Different modules at versions, without those of which only the module file is named."""
    parts = F.transform(lines, lambda x: F.filter(F.split(x, r"\s+", -1), lambda p: p != ""))
    named = F.filter(parts, lambda p: (F.size(p) > 1) & ~F.coalesce(F.get(p, F.lit(1)), F.lit("")).endswith("/go.mod"))
    return F.size(F.array_distinct(F.transform(named, lambda p: F.concat(p[0], F.lit("@"), p[1]))))


def count_bundler(lines: Column) -> Column:
    """Lines with a version in a `specs:` part, which ends with the first line that is less indented."""

    def step(s: Column, x: Column) -> Column:
        begins, deep = trim(x) == "specs:", x.startswith("    ")
        inside = s["open"] & ~begins
        return F.struct((begins | (inside & deep)).alias("open"), (s["n"] + (inside & deep & (trim(x) != "") & F.contains(x, F.lit("("))).cast("int")).alias("n"))

    return F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.lit(0).alias("n")), step, lambda s: s["n"])


def lockfiles(contents: DataFrame) -> DataFrame:
    """(path, kind, dependencies) of every lockfile among (path, text); a null text counts 0."""
    text, lines = F.coalesce("text", F.lit("")), lines_of(F.coalesce("text", F.lit("")))
    matching = lambda f: F.size(F.filter(lines, f))
    counts = {
        "cargo": F.regexp_count(text, F.lit(r"\[\[package\]\]")), "npm": count_npm(text), "pnpm": matching(lambda x: F.ltrim(x, F.lit(" \t")).startswith("/") & F.contains(x, F.lit(":"))),
        "yarn": matching(lambda x: (trim(x) != "") & ~trim(x).startswith("#") & ~trim(x).startswith("version") & ~x.startswith("  ") & x.endswith(":")), "go": count_go(lines), "bundler": count_bundler(lines),
    }
    name = file_name(F.col("path"))
    kind = F.coalesce(*(F.when(name == n, k) for n, k in KINDS.items()))
    rows = contents.where(name.isin(list(KINDS))).withColumn("kind", kind)
    return rows.select("path", "kind", F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in counts.items())).cast("long").alias("dependencies"))


def dependency_report(contents: DataFrame) -> DataFrame:
    """(kind, lockfiles, dependencies)."""
    return lockfiles(contents).groupBy("kind").agg(F.count("*").alias("lockfiles"), F.sum("dependencies").alias("dependencies"))


def license_candidates(files: DataFrame) -> DataFrame:
    """(path, kind) of files that may state a licence: kind is license, or metadata for manifests."""
    name = F.lower(file_name(F.col("path")))
    begins = name.startswith(LICENSE_NAMES[0])
    for n in LICENSE_NAMES[1:]:
        begins = begins | name.startswith(n)
    return files.select("path", F.when(name.isin(MANIFESTS), "metadata").when(begins, "license").alias("kind")).where("kind is not null")


def declared_licenses(contents: DataFrame) -> DataFrame:
    """(path, license) that manifests declare: the `license` of package.json (or its type), that of [package] or [project] in TOML."""
    name = F.lower(file_name(F.col("path")))
    whole = F.try_parse_json(F.col("text"))
    field = lambda p: F.try_variant_get(whole, p, "string")
    package = F.when(F.schema_of_variant(F.try_variant_get(whole, "$.license", "variant")) == "STRING", field("$.license")).otherwise(field("$.license.type"))
    part = F.regexp_extract("text", r"(?ms)^\[(?:package|project)\][ \t]*$(.*?)(?=^\[|\z)", 1)
    toml = F.coalesce(*(F.nullif(F.regexp_extract(part, p, 1), F.lit("")) for p in (r"(?m)^[ \t]*license[ \t]*=[ \t]*[\"']([^\"']*)[\"']", r"(?m)^[ \t]*license[ \t]*=[ \t]*\{[^}\n]*text[ \t]*=[ \t]*[\"']([^\"']*)[\"']")))
    found = F.when(name == "package.json", package).when(name.isin("cargo.toml", "pyproject.toml"), toml)
    return contents.select("path", trim(found).alias("license")).where("license <> ''")
