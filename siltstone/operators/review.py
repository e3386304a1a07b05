"""Review operators over numstat (path, insertions, deletions), added lines (path, line) and coverage (path, line, hits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import ratio


def change_surface(stats: DataFrame, commits: int) -> DataFrame:
    """Totals, changes per commit, and the share of changes in the top fifth of files.

    The top fifth is found from a count of files per number of changed lines, so no window holds all files.
    """
    rows = stats.withColumn("changed", (F.col("insertions") + F.col("deletions")).cast("long"))
    total = rows.agg(F.count("*").alias("files_changed"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("insertions", "deletions", "changed")))
    by = rows.groupBy("changed").agg(F.count("*").alias("c"))
    order = Window.orderBy(F.desc("changed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    quota = F.ceil(F.lit(0.2) * F.col("n"))
    taken = F.greatest(F.least(F.col("upto"), quota) - (F.col("upto") - F.col("c")), F.lit(0))
    top = ranked.agg(F.coalesce(F.sum(taken * F.col("changed")), F.lit(0)).cast("long").alias("top"))
    out = total.crossJoin(F.broadcast(top))
    return out.select(
        F.lit(commits).cast("long").alias("commits"), "files_changed", "insertions", "deletions", (F.col("insertions") - F.col("deletions")).alias("net_lines"),
        ratio("changed", F.lit(commits)).alias("churn_velocity"), ratio("top", "changed").alias("change_concentration"),
    )


def composition(stats: DataFrame) -> DataFrame:
    """Shares of code, test, docs and config files by extension; other files count nowhere."""
    p = F.lower("path")
    source = p.rlike(r"\.(rs|js|ts|py)$")
    test = p.contains("test") | p.contains("_spec")
    kind = F.when(source & test, "test").when(source, "code").when(p.endswith(".md") | p.contains("/docs/"), "docs").when(p.rlike(r"\.(toml|json|yml|yaml)$"), "config")
    n = stats.withColumn("k", kind).agg(*(F.coalesce(F.sum((F.col("k") == k).cast("long")), F.lit(0)).cast("long").alias(k) for k in ("code", "test", "docs", "config")))
    total = F.col("code") + F.col("test") + F.col("docs") + F.col("config")
    return n.select(*(ratio(k, total).alias(f"{k}_pct") for k in ("code", "test", "docs", "config")), F.when(F.col("code") > 0, ratio("test", "code")).when(F.col("test") > 0, 1.0).otherwise(0.0).alias("test_ratio"))


def contracts(stats: DataFrame, cli_roots: list[str], schema_files: list[str]) -> DataFrame:
    """Whether API, command-line or schema files changed; breaking counts API and schema."""
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    cli = F.lit(False)
    for root in cli_roots:
        cli = cli | F.col("path").startswith(root)
    out = stats.agg(some(F.col("path").rlike(r"(lib|mod)\.rs$")).alias("api_changed"), some(cli).alias("cli_changed"), some(F.col("path").isin(schema_files) if schema_files else F.lit(False)).alias("schema_changed"))
    return out.withColumn("breaking_indicators", F.col("api_changed").cast("long") + F.col("schema_changed").cast("long"))


def code_health(stats: DataFrame, contract: DataFrame, large: int = 500) -> DataFrame:
    changed = F.col("insertions") + F.col("deletions")
    one = stats.agg(F.coalesce(F.sum((changed > large).cast("long")), F.lit(0)).cast("long").alias("large_files_touched"), F.coalesce(F.sum(changed), F.lit(0)).cast("long").alias("t"), F.count("*").alias("n"))
    one = one.crossJoin(F.broadcast(contract.select("breaking_indicators")))  # one row each
    score = F.greatest(F.greatest(100 - 10 * F.col("large_files_touched"), F.lit(0)) - F.when(F.col("breaking_indicators") > 0, 20).otherwise(0), F.lit(0)).cast("long")
    one = one.withColumn("score", score)
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    big = F.col("large_files_touched")
    indicator = F.when(big > 5, "critical").when(big > 2, "high").when(big > 0, "medium").otherwise("low")
    return one.select("score", grade.alias("grade"), "large_files_touched", F.when(F.col("n") > 0, F.floor(F.col("t") / F.col("n"))).otherwise(0).cast("long").alias("avg_file_size"), indicator.alias("complexity_indicator"))


def risk(stats: DataFrame, health: DataFrame, least: int = 300) -> DataFrame:
    """(hotspots_touched, score, level): files with over `least` changed lines, and 100 minus health."""
    n = stats.where(F.col("insertions") + F.col("deletions") > least).agg(F.count("*").alias("hotspots_touched"))
    out = n.crossJoin(F.broadcast(health.select(F.col("score").alias("h"))))  # one row each
    score = F.least(F.col("hotspots_touched") * 15 + 100 - F.col("h"), F.lit(100)).cast("long")
    return out.select("hotspots_touched", score.alias("score"), F.when(score <= 20, "low").when(score <= 50, "medium").when(score <= 80, "high").otherwise("critical").alias("level"))


def review_plan(stats: DataFrame, contract: DataFrame) -> DataFrame:
    """(path, reason, priority, complexity, lines_changed) by priority, signal, path."""
    lines = F.col("insertions") + F.col("deletions")
    api = F.col("path").rlike(r"(lib|mod)\.rs$")
    schema = F.col("path").rlike(r"^docs/(schema\.json|SCHEMA\.md|.*\.schema\.json)$")
    policy = F.col("path").rlike(r"^(policy/|\.github/workflows/|codecov\.yml$)")
    both = stats.withColumn("lines_changed", lines.cast("long")).crossJoin(F.broadcast(contract))  # one row
    signal = F.when(schema & F.col("schema_changed"), 1).when(policy, 2).when(api & F.col("api_changed"), 4).otherwise(5)
    reason = F.when(signal == 1, "schema contract changed; ").when(signal == 2, "proof or policy routing changed; ").when(signal == 4, "API surface changed; ").otherwise("")
    by_lines = F.when(F.col("lines_changed") > 200, 1).when(F.col("lines_changed") > 50, 2).otherwise(3)
    priority = F.least(by_lines, F.when(signal <= 2, 1).when(signal == 4, 2).otherwise(3)).cast("long")
    complexity = F.when(F.col("lines_changed") > 300, 5).when(F.col("lines_changed") > 100, 3).otherwise(1).cast("long")
    rank = F.when(schema, 1).when(policy, 2).when(api, 4).otherwise(5).cast("long")
    out = both.select("path", F.concat(reason, F.col("lines_changed").cast("string"), F.lit(" lines changed")).alias("reason"), priority.alias("priority"), rank.alias("signal_rank"), complexity.alias("complexity"), "lines_changed")
    return out.orderBy("priority", "signal_rank", "path")


def uncovered(added: DataFrame, coverage: DataFrame) -> DataFrame:
    """Added lines that no run hit."""
    hits = coverage.select("path", "line", F.col("hits"))
    return added.join(hits, ["path", "line"], "left").where(F.coalesce("hits", F.lit(0)) <= 0).select("path", "line")


def diff_coverage(added: DataFrame, coverage: DataFrame) -> DataFrame:
    """(lines_added, lines_covered, coverage, status): rounded to 2 digits before the thresholds 0.8 and 0.5."""
    both = added.join(coverage, ["path", "line"], "left")
    one = both.agg(F.count("*").alias("lines_added"), F.coalesce(F.sum((F.coalesce("hits", F.lit(0)) > 0).cast("long")), F.lit(0)).cast("long").alias("lines_covered"))
    one = one.withColumn("coverage", ratio("lines_covered", "lines_added", 2))
    return one.withColumn("status", F.when(F.col("coverage") >= 0.8, "pass").when(F.col("coverage") >= 0.5, "warn").otherwise("fail"))


def hunks(lines: DataFrame) -> DataFrame:
    """(path, start_line, end_line) of runs of consecutive lines; one window per file."""
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return lines.distinct().withColumn("g", island).groupBy("path", "g").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("g")


def complexity_gate(files: DataFrame, most: int = 15) -> DataFrame:
    """0 files above `most` pass, up to 3 warn, more fail; files: rust_complexity, or (cyclomatic) of each file's largest function."""
    n = files.agg(F.coalesce(F.sum((F.col("cyclomatic") > most).cast("long")), F.lit(0)).cast("long").alias("high_files"))
    return n.withColumn("status", F.when(F.col("high_files") == 0, "pass").when(F.col("high_files") <= 3, "warn").otherwise("fail"))


def overall_status(gates: DataFrame) -> DataFrame:
    """fail, else pass if all pass, else pending, warn, skipped, pass; gates: (gate, status)."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    every = F.coalesce(F.bool_and(F.col("status") == "pass"), F.lit(True))
    out = F.when(has("fail"), "fail").when(every, "pass").when(has("pending"), "pending").when(has("warn"), "warn").when(has("skipped"), "skipped").otherwise("pass")
    return gates.agg(out.alias("status"))


# Precedence of evidence states.
EVIDENCE = ["missing", "stale", "degraded", "available", "skipped", "unavailable"]


def evidence_status(items: DataFrame) -> DataFrame:
    """(item, status): the state that comes first in precedence among an item's evidence."""
    place = F.array_position(F.array(*map(F.lit, EVIDENCE)), F.col("status"))
    return items.groupBy("item").agg(F.min(F.when(place > 0, place)).alias("k")).select("item", F.element_at(F.array(*map(F.lit, EVIDENCE)), F.col("k").cast("int")).alias("status"))


def metric_trend(pairs: DataFrame, still: float = 1.0) -> DataFrame:
    """(name, old, new, delta, direction): stable where |delta| < still."""
    d = F.col("new") - F.col("old")
    return pairs.select("name", "old", "new", d.alias("delta"), F.when(F.abs(d) < still, "stable").when(d > 0, "up").otherwise("down").alias("direction"))
