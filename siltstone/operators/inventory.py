"""Inventory roll-ups over file rows (path, module, lang, kind, code, comments, blanks, lines, bytes, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import avg_half_up, is_infra_lang, is_test_path, path_depth, ratio, round_away

MEASURES = ["code", "lines", "bytes", "tokens"]


def parents(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'parent'")


def sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names]


def lang_rows(rows: DataFrame, children: str = "collapse") -> DataFrame:
    """(lang, code, lines, files, bytes, tokens, avg_lines). collapse: children count only where their parent is missing;
    separate: parents without their children's lines, children as "X (embedded)" without bytes. Groups without code go.
    """
    own, child = parents(rows), rows.where("kind = 'child'")
    if children == "collapse":
        base = own.unionByName(child.join(own.select("path").distinct(), "path", "left_anti"))
    else:
        inner = child.groupBy("path").agg(F.sum("code").alias("_code"), F.sum("lines").alias("_lines"))
        rest = lambda a, b: F.greatest(F.col(a) - F.coalesce(b, F.lit(0)), F.lit(0)).cast("long")
        own = own.join(inner, "path", "left").withColumn("code", rest("code", "_code")).withColumn("lines", rest("lines", "_lines")).drop("_code", "_lines")
        zero = F.lit(0).cast("long")
        base = own.unionByName(child.withColumn("lang", F.concat("lang", F.lit(" (embedded)"))).withColumn("bytes", zero).withColumn("tokens", zero))
    out = base.groupBy("lang").agg(*sums("code", "lines"), F.countDistinct("path").alias("files"), *sums("bytes", "tokens")).where("code > 0")
    return out.withColumn("avg_lines", avg_half_up("lines", "files"))


def module_rows(rows: DataFrame) -> DataFrame:
    """(module, code, lines, files, bytes, tokens, avg_lines): sums over parents and children, files counts parents."""
    out = rows.groupBy("module").agg(*sums("code", "lines"), F.countDistinct(F.when(F.col("kind") == "parent", F.col("path"))).alias("files"), *sums("bytes", "tokens"))
    return out.withColumn("avg_lines", avg_half_up("lines", "files"))


def fold_other(report: DataFrame, key: str, top: int) -> DataFrame:
    """Keep the top rows by code; the rest become one row "Other". A report has a row per language or module, so its rank is one small window."""
    if top <= 0:
        return report
    rank = F.row_number().over(Window.orderBy(F.desc("code"), F.asc(key)))
    named = report.withColumn(key, F.when(rank > top, F.lit("Other")).otherwise(F.col(key)))
    return named.groupBy(key).agg(*sums("code", "lines", "files", "bytes", "tokens")).withColumn("avg_lines", avg_half_up("lines", "files"))


def lang_report(rows: DataFrame, top: int = 0, children: str = "collapse") -> DataFrame:
    return fold_other(lang_rows(rows, children), "lang", top).orderBy(F.desc("code"), "lang")


def module_report(rows: DataFrame, top: int = 0) -> DataFrame:
    return fold_other(module_rows(rows), "module", top).orderBy(F.desc("code"), "module")


def export_rows(rows: DataFrame, min_code: int = 0, max_rows: int = 0) -> DataFrame:
    """File rows by code descending, path ascending; max_rows is the report's own limit (0: none)."""
    out = rows.where(F.col("code") >= min_code).orderBy(F.desc("code"), "path")
    return out.limit(max_rows) if max_rows > 0 else out


def totals(rows: DataFrame) -> DataFrame:
    own = parents(rows)
    return own.agg(F.count("*").alias("files"), *sums("code", "comments", "blanks", "lines", "bytes", "tokens"))


def unique_parent_files(rows: DataFrame) -> DataFrame:
    return parents(rows).agg(F.countDistinct("path").alias("files"))


def grouped_ratio(rows: DataFrame, top: Column, bottom: Column, digits: int = 4) -> DataFrame:
    """(scope, key, numerator, denominator, ratio) overall, by language and by module, in one grouping-sets pass."""
    own = parents(rows).select("lang", "module", top.alias("a"), bottom.alias("b"))
    sets = own.groupingSets([[], ["lang"], ["module"]], "lang", "module").agg(
        F.grouping_id("lang", "module").alias("g"), F.sum("a").cast("long").alias("numerator"), F.sum("b").cast("long").alias("denominator")
    )
    scope = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "lang").otherwise("module")
    key = F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("lang")).otherwise(F.col("module"))
    return sets.select(scope.alias("scope"), key.alias("key"), "numerator", "denominator", ratio("numerator", "denominator", digits).alias("ratio"))


def doc_density(rows: DataFrame) -> DataFrame:
    return grouped_ratio(rows, F.col("comments"), F.col("code") + F.col("comments"))


def whitespace(rows: DataFrame) -> DataFrame:
    return grouped_ratio(rows, F.col("blanks"), F.col("code") + F.col("comments"))


def verbosity(rows: DataFrame) -> DataFrame:
    return grouped_ratio(rows, F.col("bytes"), F.col("lines"))


def max_files(rows: DataFrame) -> DataFrame:
    """(scope, key, path, lines): the longest file overall (of equals the largest path), per language and module (the smallest path)."""
    own = parents(rows)
    overall = own.agg(F.max(F.struct("lines", "path")).alias("m")).where("m is not null").select(F.lit("overall").alias("scope"), F.lit("").alias("key"), "m.path", "m.lines")
    out = overall
    for key in ("lang", "module"):
        best = own.groupBy(F.col(key).alias("key")).agg(F.min(F.struct((-F.col("lines")).alias("m"), "path")).alias("b"))
        out = out.unionByName(best.select(F.lit(key).alias("scope"), "key", "b.path", (-F.col("b.m")).alias("lines")))
    return out


def lang_purity(rows: DataFrame) -> DataFrame:
    """Per module: languages, the dominant one by lines (of equals the smallest name), its share."""
    by = parents(rows).groupBy("module", "lang").agg(F.sum("lines").cast("long").alias("lines"))
    out = by.groupBy("module").agg(F.count("*").alias("lang_count"), F.sum("lines").cast("long").alias("total_lines"), F.min(F.struct((-F.col("lines")).alias("m"), "lang")).alias("b"))
    return out.select("module", "lang_count", F.col("b.lang").alias("dominant_lang"), (-F.col("b.m")).alias("dominant_lines"), ratio(-F.col("b.m"), "total_lines").alias("dominant_pct"))


def polyglot(rows: DataFrame) -> DataFrame:
    """Languages with code, their entropy in bits, the dominant language and its share."""
    by = parents(rows).groupBy("lang").agg(F.sum("code").cast("long").alias("code")).where("code > 0")
    total = by.agg(F.sum("code").cast("long").alias("total"))
    p = F.col("code").cast("double") / F.col("total").cast("double")
    out = by.crossJoin(F.broadcast(total))  # the total is one row
    best = F.min(F.struct((-F.col("code")).alias("m"), "lang"))
    out = out.agg(F.count("*").alias("lang_count"), F.sum(-p * F.log2(p)).alias("e"), best.alias("b"), F.max("total").alias("total"))
    return out.select("lang_count", round_away(F.coalesce("e", F.lit(0.0)), 4).alias("entropy"), F.col("b.lang").alias("dominant_lang"), (-F.col("b.m")).alias("dominant_lines"), ratio(-F.col("b.m"), "total").alias("dominant_pct"))


def nesting(rows: DataFrame) -> DataFrame:
    """(scope, module, max_depth, avg_depth) of path depths."""
    own = parents(rows).select("module", path_depth("path").alias("d"))
    sets = own.groupingSets([[], ["module"]], "module").agg(F.grouping("module").alias("g"), F.max("d").alias("max_depth"), F.sum("d").alias("s"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 1, "total").otherwise("module").alias("scope"), F.when(F.col("g") == 1, "").otherwise(F.col("module")).alias("module"), "max_depth", ratio("s", "n", 2).alias("avg_depth"))


def test_density(rows: DataFrame, path: Column | None = None) -> DataFrame:
    own = parents(rows).withColumn("t", is_test_path(path if path is not None else F.col("path")))
    part = lambda value, test: F.coalesce(F.sum(F.when(F.col("t") == test, value)), F.lit(0)).cast("long")
    out = own.agg(part(F.col("code"), True).alias("test_lines"), part(F.col("code"), False).alias("prod_lines"), part(F.lit(1), True).alias("test_files"), part(F.lit(1), False).alias("prod_files"))
    return out.withColumn("ratio", ratio("test_lines", F.col("test_lines") + F.col("prod_lines")))


def boilerplate(rows: DataFrame) -> DataFrame:
    own = parents(rows).withColumn("i", is_infra_lang("lang"))
    part = lambda infra: F.coalesce(F.sum(F.when(F.col("i") == infra, F.col("lines"))), F.lit(0)).cast("long")
    out = own.agg(part(True).alias("infra_lines"), part(False).alias("logic_lines"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("i"), F.col("lang")))), ",").alias("infra_langs"))
    return out.withColumn("ratio", ratio("infra_lines", F.col("infra_lines") + F.col("logic_lines")))


def distribution(rows: DataFrame, value: str = "lines") -> DataFrame:
    """count, min, max, mean, median, p90, p99 and gini of a value.

    Ranks come from a table of distinct values and their counts, so the one global window holds values, not files.
    Percentile p is the element at ceil(p (n - 1)) from 0.
    """
    by = parents(rows).groupBy(F.col(value).cast("long").alias("x")).agg(F.count("*").alias("c"))
    order = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    before = F.col("upto") - F.col("c")
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    n = F.col("n")
    # sum over ranks i of (2 i - n - 1) x for the c equal values after `before`
    weighted = F.col("x") * F.col("c") * (2 * before + F.col("c") - n)
    out = ranked.agg(
        F.max("n").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.col("x") * F.col("c")).alias("s"), at(F.floor((n - 1) / 2)).alias("m1"), at(F.ceil((n - 1) / 2)).alias("m2"),
        at(F.ceil(F.lit(0.9) * (n - 1))).alias("p90"), at(F.ceil(F.lit(0.99) * (n - 1))).alias("p99"), F.sum(weighted).alias("w"),
    )
    median = round_away((F.col("m1") + F.col("m2")).cast("double") / 2, 2)
    return out.where("count > 0").select("count", "min", "max", ratio("s", "count", 2).alias("mean"), median.alias("median"), "p90", "p99", ratio("w", F.col("count") * F.col("s")).alias("gini"))


# Size and age buckets.
SIZE_BUCKETS = [("0-50", 0, 50), ("51-200", 51, 200), ("201-500", 201, 500), ("501-1000", 501, 1000), ("1001+", 1001, None)]


def bucketed(values: DataFrame, value: str, buckets: list[tuple[str, int, int | None]]) -> DataFrame:
    """(bucket_order, label, files, pct): every bucket stands, empty or not; pct of all rows."""
    spark = values.sparkSession
    label = F.coalesce(*(F.when((F.col(value) >= low) & (F.lit(True) if high is None else F.col(value) <= high), F.lit(k)) for k, (_, low, high) in enumerate(buckets)))
    counts = values.groupBy(label.alias("bucket_order")).agg(F.count("*").alias("files"))
    total = values.agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(k, b[0]) for k, b in enumerate(buckets)], "bucket_order int, label string")
    out = names.join(counts, "bucket_order", "left").crossJoin(F.broadcast(total))
    files = F.coalesce("files", F.lit(0)).cast("long")
    return out.select("bucket_order", "label", files.alias("files"), ratio(files, "n").alias("pct"))


def size_histogram(rows: DataFrame) -> DataFrame:
    return bucketed(parents(rows), "lines", SIZE_BUCKETS)


def stat_rows(rows: DataFrame) -> DataFrame:
    doc = F.when(F.col("code") + F.col("comments") > 0, ratio("comments", F.col("code") + F.col("comments")))
    return parents(rows).withColumn("doc_pct", doc).withColumn("bytes_per_line", F.when(F.col("lines") > 0, ratio("bytes", "lines"))).withColumn("depth", path_depth("path"))


def top_offenders(rows: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """One of the five top lists of n files: largest_lines, largest_tokens, largest_bytes, least_documented, most_dense."""
    stats = stat_rows(rows)
    if kind.startswith("largest_"):
        by = kind.removeprefix("largest_")
        ordered = stats.orderBy(F.desc(by), "path")
    elif kind == "least_documented":
        ordered = stats.where("lines >= 50 and doc_pct is not null").orderBy("doc_pct", F.desc("lines"), "path")
    else:
        ordered = stats.where("lines >= 10 and bytes_per_line is not null").orderBy(F.desc("bytes_per_line"), "path")
    return ordered.limit(n)


def reading_time(rows: DataFrame, lines_per_minute: int = 20) -> DataFrame:
    return totals(rows).select(ratio("code", F.lit(lines_per_minute), 2).alias("minutes"), F.lit(lines_per_minute).cast("long").alias("lines_per_minute"), F.col("code").alias("basis_lines"))


def context_window(rows: DataFrame, window: int = 128_000) -> DataFrame:
    return totals(rows).select(F.lit(window).cast("long").alias("window_tokens"), F.col("tokens").alias("total_tokens"), ratio("tokens", F.lit(window)).alias("pct"), (F.col("tokens") <= window).alias("fits"))


def cocomo(rows: DataFrame, a: float = 2.4, b: float = 1.05, c: float = 2.5, d: float = 0.38) -> DataFrame:
    """Organic effort model; no row without code."""
    kloc = F.col("code").cast("double") / 1000.0
    effort = F.lit(a) * F.pow("kloc", F.lit(b))
    out = totals(rows).where("code > 0").withColumn("kloc", kloc).withColumn("e", effort).withColumn("t", F.lit(c) * F.pow("e", F.lit(d)))
    return out.select(round_away("kloc", 4).alias("kloc"), round_away("e", 2).alias("effort_pm"), round_away("t", 2).alias("duration_months"), round_away(F.col("e") / F.col("t"), 2).alias("staff"))


def digest_tree(entries: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, hash, entries) over the different values of column entry, for each value of the keys.

    Entries are digested in sorted order per leaf of a tree: the first five hex digits of an entry's own digest name its
    leaf, so a leaf is a millionth of all files. The digests of a node's leaves are digested in order, 1024 to a node,
    and then those of the nodes, so no list of all files is ever built in one place.
    """
    own = entries.withColumn("b", F.conv(F.substring(F.sha2("entry", 256), 1, 5), 16, 10).cast("long"))

    def joined(column: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias(column)

    leaves = own.groupBy(*keys, "b").agg(F.array_sort(F.collect_set("entry")).alias("es"))
    leaves = leaves.select(*keys, "b", F.sha2(F.array_join("es", "\n"), 256).alias("h"), F.size("es").alias("n"))
    inner = leaves.groupBy(*keys, F.shiftright("b", 10).alias("node")).agg(joined("h"), F.sum("n").alias("n")).withColumnRenamed("node", "b")
    return inner.groupBy(*keys).agg(joined("hash"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entries"))


def integrity(rows: DataFrame) -> DataFrame:
    """(algo, hash, entries): digest over "path:bytes:lines" of all parents."""
    entry = F.concat_ws(":", "path", F.col("bytes").cast("string"), F.col("lines").cast("string"))
    return digest_tree(parents(rows).select(entry.alias("entry"))).select(F.lit("sha256").alias("algo"), "hash", "entries")


def path_tree(rows: DataFrame, max_depth: int = 0) -> DataFrame:
    """(node, depth, files, lines, tokens) for every directory and file: a path counts in each of its prefixes."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", 1, k), "/"))
    nodes = parents(rows).withColumn("p", parts).where(F.size("p") > 0).select(F.posexplode(prefixes).alias("k", "node"), "lines", "tokens")
    out = nodes.groupBy("node", (F.col("k") + 1).alias("depth")).agg(F.count("*").alias("files"), *sums("lines", "tokens"))
    return out.where(F.col("depth") <= max_depth) if max_depth else out


def lang_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer comparison of two language reports; languages equal in every measure are left out."""
    names = ["code", "lines", "files", "bytes", "tokens"]
    a = old.select("lang", *(F.col(n).alias(f"old_{n}") for n in names))
    b = new.select("lang", *(F.col(n).alias(f"new_{n}") for n in names))
    both = a.join(b, "lang", "full_outer").fillna(0)
    changed = both.where(" or ".join(f"old_{n} <> new_{n}" for n in names))
    return changed.select("lang", *(c for n in names for c in (F.col(f"old_{n}"), F.col(f"new_{n}"), (F.col(f"new_{n}") - F.col(f"old_{n}")).alias(f"delta_{n}"))))


def diff_totals(diff: DataFrame) -> DataFrame:
    return diff.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in diff.columns if c != "lang"))


def size_basis(tagged: DataFrame) -> DataFrame:
    """(tag, files, code, pct_of_code) of rows with a tag."""
    total = tagged.agg(F.sum("code").cast("long").alias("all"))
    by = tagged.groupBy("tag").agg(F.count("*").alias("files"), *sums("code"))
    return by.crossJoin(F.broadcast(total)).select("tag", "files", "code", ratio("code", "all").alias("pct_of_code"))
