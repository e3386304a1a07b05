"""Column functions with fully specified rounding, shared by all operators. No Python runs on the executors here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def long(x: Column | str) -> Column:
    return col(x).cast("long")


def round_away(x: Column | str, digits: int) -> Column:
    """Half away from zero on the scaled double; Spark's round() works on the decimal rendering instead."""
    x, f = col(x).cast("double"), float(10**digits)
    return F.when(x < 0, -F.floor(-x * f + 0.5) / f).otherwise(F.floor(x * f + 0.5) / f)


def ratio(a: Column | str, b: Column | str, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(F.floor(a / b * float(10**digits) + 0.5) / float(10**digits))


def avg_half_up(total: Column | str, n: Column | str) -> Column:
    """Whole-number mean rounded half up, 0 where n is 0."""
    total, n = long(total), long(n)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.floor((total + F.floor(n / 2)) / n).cast("long"))


def path_depth(path: Column | str) -> Column:
    return F.greatest(F.size(F.filter(F.split(col(path), "/"), lambda s: s != "")), F.lit(1)).cast("long")


def normalize_path(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(path), r"\\", "/"), r"^(\./)+", "")


def module_key(path: Column | str, roots: list[str], depth: int) -> Column:
    """(root) without a directory; the first directory if it is no root; else up to `depth` directories."""
    parts = F.split(F.regexp_replace(normalize_path(path), "^/+", ""), "/")
    dirs = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: (s != "") & (s != "."))
    first = F.element_at(dirs, 1)
    return F.when(F.size(dirs) == 0, F.lit("(root)")).when(~first.isin(roots) if roots else F.lit(True), first).otherwise(F.array_join(F.slice(dirs, 1, max(depth, 1)), "/"))


def is_test_path(path: Column | str) -> Column:
    lower = F.lower(col(path))
    name = F.element_at(F.split(lower, "/"), -1)
    return lower.rlike(r"(^|/)(test|tests|spec|specs)(/|$)") | lower.contains("__tests__") | name.rlike(r"_test|\.test\.|\.spec\.|^test_")


# Languages that count as infrastructure.
INFRA_LANGS = "cmake css csv dockerfile editorconfig gitconfig gitignore hcl html ini json less makefile markdown nix properties scss svg terraform toml tsv xml yaml".split()


def is_infra_lang(lang: Column | str) -> Column:
    return F.lower(col(lang)).isin(INFRA_LANGS)


def has_word(text: Column, words: list[str]) -> Column:
    """One of the words between characters that are no ASCII letter or digit."""
    return text.rlike(rf"(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])")


# Conventional prefixes and keywords of commit intents, in the order in which they are tried.
INTENT_PREFIXES = [
    ("feat", ["feat", "feature"]), ("fix", ["fix", "bugfix", "hotfix"]), ("refactor", ["refactor"]), ("docs", ["docs", "doc"]), ("test", ["test", "tests"]),
    ("chore", ["chore"]), ("ci", ["ci"]), ("build", ["build"]), ("perf", ["perf"]), ("style", ["style"]), ("revert", ["revert"]),
]
INTENT_WORDS = [
    ("revert", ["revert"]), ("fix", ["fix", "bug", "patch", "hotfix"]), ("feat", ["feat", "feature"]), ("refactor", ["refactor", "restructure"]), ("docs", ["doc", "readme"]),
    ("test", ["test"]), ("perf", ["perf", "performance", "optimize"]), ("style", ["style", "format", "lint"]), ("ci", ["ci", "pipeline"]), ("build", ["build", "deps"]), ("chore", ["chore", "cleanup"]),
]
FEAT_STARTS = r"^(add|implement|introduce) "


def commit_intent(subject: Column | str) -> Column:
    """revert prefix, then conventional prefix, then keywords, else other."""
    text = F.trim(F.coalesce(col(subject), F.lit("")))
    lower = F.lower(text)
    prefix = F.rtrim(F.regexp_replace(F.regexp_extract(text, r"^([^:(]*)(\([^:]*)?:", 1), "!+$", ""))
    prefix = F.lower(prefix)
    out = F.when(text.startswith('Revert "') | text.startswith("revert:"), "revert")
    for kind, names in INTENT_PREFIXES:
        out = out.when(prefix.isin(names), kind)
    for kind, words in INTENT_WORDS:
        hit = has_word(lower, words)
        out = out.when(hit | lower.rlike(FEAT_STARTS) if kind == "feat" else hit, kind)
    return out.otherwise("other")


def email_domain(author: Column | str) -> Column:
    """Lower-case domain of an address with exactly one @, else null."""
    parts = F.split(col(author), "@")
    domain = F.lower(F.trim(F.try_element_at(parts, F.lit(2))))
    return F.when((F.size(parts) == 2) & (domain != ""), domain)


def short_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 16)


def redact_path(path: Column | str) -> Column:
    """Hash of the path, keeping a plain extension."""
    clean = normalize_path(path)
    ext = F.regexp_extract(F.element_at(F.split(clean, "/"), -1), r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.when(ext == "", short_hash(clean)).otherwise(F.concat_ws(".", short_hash(clean), ext))
