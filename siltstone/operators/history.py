"""History operators over commits (seq, ts, author, hash, subject), commit_files (seq, path) and files (path, module, lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import commit_intent, email_domain, ratio, round_away
from siltstone.operators.inventory import bucketed

DAY, WEEK = 86_400, 604_800
# Age buckets in days.
AGE_BUCKETS = [("0-30", 0, 30), ("31-90", 31, 90), ("91-180", 91, 180), ("181-365", 181, 365), ("366+", 366, None)]
# Mail domains that are pooled, and names that are left out.
PUBLIC_DOMAINS = ["gmail.com", "hotmail.com", "icloud.com", "outlook.com", "protonmail.com", "users.noreply.github.com", "yahoo.com"]
IGNORED_DOMAINS = ["example.com", "localhost"]


def touches(commits: DataFrame, commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """One row per commit and tracked file. Untracked paths are left out; Spark broadcasts `files` only where it is small."""
    return commit_files.join(files, "path").join(commits, "seq")


def hotspots(touched: DataFrame) -> DataFrame:
    """(path, commits, lines, score): score = lines x commits."""
    return touched.groupBy("path", "lines").agg(F.count("*").alias("commits")).withColumn("score", F.col("lines") * F.col("commits")).orderBy(F.desc("score"), "path")


def bus_factor(touched: DataFrame) -> DataFrame:
    return touched.groupBy("module").agg(F.countDistinct("author").alias("authors")).orderBy("authors", "module")


def last_changes(touched: DataFrame) -> DataFrame:
    """(path, module, last_change): the time of the first commit in log order, which lists the newest first."""
    return touched.groupBy("path", "module").agg(F.max(F.struct("ts", "seq")).alias("m")).select("path", "module", F.col("m.ts").alias("last_change"))


def ages(touched: DataFrame) -> DataFrame:
    newest = touched.agg(F.max("ts").alias("newest"))
    return last_changes(touched).crossJoin(F.broadcast(newest)).withColumn("age_days", F.floor((F.col("newest") - F.col("last_change")) / DAY).cast("long"))  # one row


def freshness(touched: DataFrame, stale_days: int = 365) -> DataFrame:
    """(module, files, stale_files, stale_pct, avg_days, p90_days). p90 comes from a count of files per module and age, so a module's window holds ages, not files."""
    by = ages(touched).groupBy("module", "age_days").agg(F.count("*").alias("c"))
    order = Window.partitionBy("module").orderBy("age_days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy("module")))
    out = ranked.groupBy("module").agg(
        F.max("n").alias("files"), F.sum(F.when(F.col("age_days") > stale_days, F.col("c")).otherwise(0)).cast("long").alias("stale_files"),
        F.sum(F.col("age_days") * F.col("c")).alias("s"), F.min(F.when(F.col("upto") > F.ceil(F.lit(0.9) * (F.col("n") - 1)), F.col("age_days"))).alias("p90_days"),
    )
    return out.select("module", "files", "stale_files", ratio("stale_files", "files").alias("stale_pct"), ratio("s", "files", 2).alias("avg_days"), "p90_days")


def code_age(touched: DataFrame) -> DataFrame:
    return bucketed(ages(touched), "age_days", AGE_BUCKETS)


def refresh_trend(touched: DataFrame, days: int = 30) -> DataFrame:
    """Distinct tracked files touched in the last `days` against the `days` before."""
    newest = touched.agg(F.max("ts").alias("newest"))
    age = F.col("newest") - F.col("ts")
    span = days * DAY
    both = touched.select("path", "ts").crossJoin(F.broadcast(newest))  # one row
    part = lambda cond: F.countDistinct(F.when(cond, F.col("path")))
    out = both.agg(part(age <= span).alias("recent_refreshes"), part((age > span) & (age <= 2 * span)).alias("prior_refreshes"))
    recent, prior = F.col("recent_refreshes"), F.col("prior_refreshes")
    pct = F.when(prior > 0, (recent - prior).cast("double") / prior.cast("double"))
    trend = F.when(prior == 0, F.when(recent > 0, "rising").otherwise("flat")).when(pct > 0.1, "rising").when(pct < -0.1, "falling").otherwise("flat")
    return out.withColumn("trend", trend)


def coupling(touched: DataFrame) -> DataFrame:
    """(left_module, right_module, count, n_left, n_right, jaccard, lift): modules that change in the same commits.

    Pairs are made from each commit's sorted set of modules. A commit's set holds modules, not files.
    """
    sets = touched.groupBy("seq").agg(F.array_sort(F.collect_set("module")).alias("m"))
    per = touched.select("seq", "module").distinct().groupBy("module").agg(F.count("*").alias("n"))
    total = sets.agg(F.count("*").alias("total"))
    later = lambda m: F.flatten(F.transform(m, lambda x, i: F.transform(F.slice(m, i + 2, F.size(m)), lambda y: F.struct(x.alias("left_module"), y.alias("right_module")))))
    pairs = sets.where(F.size("m") > 1).select(F.explode(later(F.col("m"))).alias("p")).groupBy("p").agg(F.count("*").alias("count")).select("p.*", "count")
    out = pairs.join(per.select(F.col("module").alias("left_module"), F.col("n").alias("n_left")), "left_module")
    out = out.join(per.select(F.col("module").alias("right_module"), F.col("n").alias("n_right")), "right_module").crossJoin(F.broadcast(total))
    return out.select(
        "left_module", "right_module", "count", "n_left", "n_right", ratio("count", F.col("n_left") + F.col("n_right") - F.col("count")).alias("jaccard"),
        ratio(F.col("count") * F.col("total"), F.col("n_left") * F.col("n_right")).alias("lift"),
    )


KINDS = ["build", "chore", "ci", "docs", "feat", "fix", "other", "perf", "refactor", "revert", "style", "test"]


def intent_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.coalesce(F.sum((F.col("intent") == k).cast("long")), F.lit(0)).cast("long").alias(k) for k in KINDS]
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), *counts) if keys else rows.agg(F.count("*").alias("total"), *counts)
    return out.withColumn("unknown_pct", ratio("other", "total")).withColumn("corrective_ratio", ratio(F.col("fix") + F.col("revert"), "total"))


def commit_intents(commits: DataFrame) -> DataFrame:
    return intent_counts(commits.withColumn("intent", commit_intent("subject")), [])


def module_intents(touched: DataFrame) -> DataFrame:
    """Per module: commits that touch it, by intent."""
    rows = touched.select("seq", "module", "subject").distinct().withColumn("intent", commit_intent("subject"))
    return intent_counts(rows, ["module"])


def churn(touched: DataFrame) -> DataFrame:
    """(module, weeks, slope, r2, recent_change, classification) of weekly commit counts; weeks without commits are not filled in."""
    week = F.floor(F.col("ts") / WEEK).cast("long")
    series = touched.select("module", "seq", week.alias("week")).distinct().groupBy("module", "week").agg(F.count("*").alias("n"))
    first = Window.partitionBy("module")
    s = series.withColumn("x", F.col("week") - F.min("week").over(first)).withColumn("last", F.max("week").over(first))
    recent = F.sum(F.when(F.col("week") > F.col("last") - 4, F.col("n")).otherwise(0)) - F.sum(F.when((F.col("week") <= F.col("last") - 4) & (F.col("week") > F.col("last") - 8), F.col("n")).otherwise(0))
    x, y = F.col("x"), F.col("n")
    out = s.groupBy("module").agg(F.count("*").alias("weeks"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), recent.cast("long").alias("recent_change"))
    # whole-number sums, one division each: equal on every engine and in every order
    a, b, c = F.col("weeks") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("weeks") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("weeks") * F.col("syy") - F.col("sy") * F.col("sy")
    out = out.withColumn("a", a).withColumn("b", b).withColumn("c", c)
    slope = F.when((F.col("weeks") < 2) | (F.col("b") == 0), F.lit(0.0)).otherwise(F.col("a").cast("double") / F.col("b").cast("double"))
    r2 = F.when((F.col("weeks") < 2) | (F.col("b") == 0) | (F.col("c") == 0), F.lit(0.0)).otherwise(
        F.least(F.col("a").cast("double") * F.col("a").cast("double") / (F.col("b").cast("double") * F.col("c").cast("double")), F.lit(1.0))
    )
    out = out.withColumn("s", slope)
    kind = F.when(F.col("s") > 0.01, "rising").when(F.col("s") < -0.01, "falling").otherwise("flat")
    return out.select("module", "weeks", round_away("s", 4).alias("slope"), round_away(r2, 4).alias("r2"), "recent_change", kind.alias("classification"))


def author_domains(commits: DataFrame) -> DataFrame:
    """(domain, commits, pct): public mail domains are pooled, placeholder ones left out."""
    rows = commits.select(email_domain("author").alias("d")).where(F.col("d").isNotNull() & ~F.col("d").isin(IGNORED_DOMAINS) & ~F.col("d").contains("noreply"))
    rows = rows.withColumn("domain", F.when(F.col("d").isin(PUBLIC_DOMAINS), "public-email").otherwise(F.col("d")))
    by = rows.groupBy("domain").agg(F.count("*").alias("commits"))
    total = by.agg(F.sum("commits").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("domain", "commits", ratio("commits", "n").alias("pct"))
