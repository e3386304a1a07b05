"""Content operators over contents (path, module, lang, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import ratio, round_away


def duplicate_members(contents: DataFrame) -> DataFrame:
    """(path, module, bytes, hash, keeper) of texts that occur more than once; the keeper is the smallest path.

    Only texts whose size occurs more than once are hashed. Groups are joined back by (bytes, hash), a join that Spark
    splits where one text has very many copies; no group is gathered.
    """
    sized = contents.select("path", "module", F.octet_length("text").cast("long").alias("bytes"), "text").where("bytes > 0")
    sizes = sized.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1").select("bytes")
    hashed = sized.join(sizes, "bytes", "left_semi").select("path", "module", "bytes", F.sha2("text", 256).alias("hash"))
    groups = hashed.groupBy("bytes", "hash").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")
    return hashed.join(groups, ["bytes", "hash"]).select("path", "module", "bytes", "hash", (F.col("path") == F.col("first")).alias("keeper"))


def duplicate_groups(contents: DataFrame) -> DataFrame:
    by = duplicate_members(contents).groupBy("hash", "bytes").agg(F.count("*").alias("files"))
    return by.select("hash", "bytes", "files", (F.col("bytes") * (F.col("files") - 1)).alias("wasted_bytes")).orderBy(F.desc("bytes"), "hash")


def duplication_density(contents: DataFrame) -> DataFrame:
    """Per module: duplicate and wasted files and bytes, and wasted bytes per byte."""
    flag = duplicate_members(contents)
    wasted = ~F.col("keeper")
    dup = flag.groupBy("module").agg(
        F.count("*").alias("duplicate_files"), F.sum(F.when(wasted, 1).otherwise(0)).cast("long").alias("wasted_files"), F.sum("bytes").cast("long").alias("duplicated_bytes"),
        F.sum(F.when(wasted, F.col("bytes")).otherwise(0)).cast("long").alias("wasted_bytes"),
    )
    total = contents.groupBy("module").agg(F.sum(F.octet_length("text")).cast("long").alias("total_bytes"))
    return dup.join(total, "module").withColumn("density", ratio("wasted_bytes", "total_bytes"))


TODO_TAGS = ["TODO", "FIXME", "HACK", "XXX"]


def tag_counts(contents: DataFrame, tags: list[str]) -> DataFrame:
    """(tag, count) of tags that no letter, digit or underscore touches; tags without a hit stand with 0."""
    hits = [F.coalesce(F.sum(F.regexp_count("text", F.lit(rf"(?U)(?i)(?<![\p{{Alnum}}_]){t}(?![\p{{Alnum}}_])"))), F.lit(0)).cast("long").alias(t) for t in tags]
    row = contents.agg(*hits)
    return row.select(F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("count")) for t in tags))).alias("x")).select("x.*")


def todo_density(contents: DataFrame, code_lines: DataFrame, tags: list[str] = TODO_TAGS) -> DataFrame:
    """(tag, count, total, per_kloc) with code_lines a one-row table of `code`."""
    by = tag_counts(contents, tags)
    total = by.agg(F.sum("count").cast("long").alias("total"))
    return by.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(code_lines.select("code"))).select("tag", "count", "total", ratio(F.col("total") * 1000, "code", 2).alias("per_kloc"))


def import_edges(links: DataFrame) -> DataFrame:
    """(source, target, count) from (source, target) links."""
    return links.groupBy("source", "target").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "source", "target")


# Path terms that are no topics.
TOPIC_STOPS = "bin build dist gen generated impl index lib main mod out package pkg src target test tests".split()
TOPIC_EXTENSIONS = "c cc cfg cpp cs dart env go h hpp ini java js json jsx kt kts lock m markdown md mm nix php py rb rs scala sql swift toml ts tsx txt yaml yml zig".split()


def topic_clouds(rows: DataFrame, roots: list[str], top: int = 8) -> DataFrame:
    """(module, term, tf, df, score): the top terms of each module and of all together ("").

    tf adds a file's tokens (at least 1) for each occurrence of the term in its path; df counts files with the term;
    score = tf x (ln((modules + 1) / (df + 1)) + 1).
    """
    stops = sorted({*TOPIC_STOPS, *TOPIC_EXTENSIONS, *(r.lower() for r in roots)})
    terms = F.filter(F.split(F.lower("path"), r"[/_\-.]"), lambda t: (t != "") & ~t.isin(stops))
    each = rows.select("path", "module", F.greatest("tokens", F.lit(1)).alias("w"), F.explode(terms).alias("term"))
    tf = each.groupBy("module", "term").agg(F.sum("w").cast("long").alias("tf"))
    df = each.groupBy("term").agg(F.countDistinct("path").alias("df"))
    modules = rows.agg(F.countDistinct("module").alias("modules"))
    both = tf.unionByName(tf.groupBy("term").agg(F.sum("tf").cast("long").alias("tf")).withColumn("module", F.lit("")))
    scored = both.join(df, "term").crossJoin(F.broadcast(modules))
    score = F.col("tf") * (F.log((F.col("modules") + 1).cast("double") / (F.col("df") + 1).cast("double")) + 1.0)
    scored = scored.select("module", "term", "tf", "df", round_away(score, 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("score"), "term"))
    return scored.withColumn("k", rank).where(F.col("k") <= top).drop("k")


def entropy_suspects(contents: DataFrame, sample_bytes: int = 1024, top: int = 50) -> DataFrame:
    """(path, module, entropy, sample_bytes, class) of files whose head and tail bytes are unusually dense or sparse.

    Shannon bits per byte over the first and last half of sample_bytes (the rule looks at no more), computed from hex
    pairs in the JVM: > 7.5 high, >= 6.5 suspicious, < 2 low; the rest is left out. top is the report's own limit.
    """
    data = F.encode("text", "UTF-8")
    head, tail = max(1, sample_bytes // 2), sample_bytes - max(1, sample_bytes // 2)
    n = F.octet_length("text")
    sample = F.when(n <= sample_bytes, F.hex(data)).otherwise(F.concat(F.hex(F.substring(data, 1, head)), F.hex(F.expr(f"substring(encode(text, 'UTF-8'), -{tail}, {tail})"))))
    pairs = contents.where(n > 0).select("path", "module", F.explode(F.regexp_extract_all(sample, F.lit("(..)"), 1)).alias("byte"))
    counts = pairs.groupBy("path", "module", "byte").agg(F.count("*").alias("c"))
    # sum of c log2 c, rounded per value so that the order of adding cannot matter
    by = counts.groupBy("path", "module").agg(F.sum("c").cast("long").alias("sample_bytes"), F.sum(F.floor(F.col("c") * F.log2("c") * 1e6 + 0.5).cast("long")).alias("s"))
    bits = F.log2(F.col("sample_bytes").cast("double")) - F.col("s").cast("double") / 1e6 / F.col("sample_bytes").cast("double")
    out = by.select("path", "module", round_away(F.greatest(bits, F.lit(0.0)), 3).alias("entropy"), "sample_bytes")
    kind = F.when(F.col("entropy") > 7.5, "high").when(F.col("entropy") >= 6.5, "suspicious").when(F.col("entropy") < 2.0, "low")
    return out.withColumn("class", kind).where("class is not null").orderBy(F.desc("entropy"), "path").limit(top)


# Licence phrases and how many of them must occur, in the order that breaks ties.
LICENSES = [
    ("MIT", 1, ["permission is hereby granted, free of charge", 'the software is provided "as is"']),
    ("Apache-2.0", 2, ["apache license", "version 2.0", "http://www.apache.org/licenses/", "limitations under the license"]),
    ("GPL-3.0-or-later", 2, ["gnu general public license", "version 3", "any later version"]),
    ("AGPL-3.0-or-later", 2, ["gnu affero general public license", "version 3", "any later version"]),
    ("BSD-3-Clause", 2, ["redistribution and use in source and binary forms", "neither the name of", "contributors may be used"]),
    ("BSD-2-Clause", 2, ["redistribution and use in source and binary forms", "this list of conditions"]),
]


def license_findings(contents: DataFrame) -> DataFrame:
    """(path, spdx, confidence): the best phrase match of each text, 0.6 + 0.4 x share of phrases; the first of equals."""
    lower = F.lower("text")
    options = []
    for k, (spdx, least, phrases) in enumerate(LICENSES):
        hits = sum((F.contains(lower, F.lit(p)).cast("int") for p in phrases), F.lit(0))
        confidence = F.lit(0.6) + F.lit(0.4) * hits.cast("double") / float(len(phrases))
        options.append(F.when(hits >= least, F.struct(round_away(confidence, 4).alias("confidence"), F.lit(-k).alias("order"), F.lit(spdx).alias("spdx"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return contents.select("path", best.alias("b")).where("b is not null").select("path", "b.spdx", "b.confidence")
