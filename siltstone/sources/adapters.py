"""Fact tables from the star-schema and text tables: files, child files, contents, commits, change statistics, line coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scalars import module_key

ROOTS = ["de", "en", "es", "fr"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path():
    return F.concat_ws("/", F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def line_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds code, comments, blanks, lines, bytes and tokens of a text column: one pass over its lines, inside the JVM."""
    lines = F.split(F.col(text), "\n", -1)
    blank = F.size(F.filter("_lines", lambda x: F.trim(x) == ""))
    comment = F.size(F.filter("_lines", lambda x: F.ltrim(x).startswith("#") | F.ltrim(x).startswith("//")))
    df = df.withColumn("_lines", lines).withColumn("blanks", blank.cast("long")).withColumn("comments", comment.cast("long")).withColumn("lines", F.size("_lines").cast("long"))
    return (
        df.withColumn("code", F.col("lines") - F.col("blanks") - F.col("comments"))
        .withColumn("bytes", F.octet_length(text).cast("long"))
        .withColumn("tokens", F.floor(F.col("bytes") / 4).cast("long"))
        .drop("_lines")
    )


FILE_COLUMNS = ["path", "module", "lang", "kind", "code", "comments", "blanks", "lines", "bytes", "tokens"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parent row per document with a text."""
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("path", document_path())
    docs = docs.withColumn("module", module_key("path", ROOTS, 2)).withColumn("lang", F.coalesce("lang", F.lit("und"))).withColumn("kind", F.lit("parent"))
    return line_counts(docs, "text").select(FILE_COLUMNS)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as parents, all their script and style blocks as children without bytes and tokens."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    pages = pages.withColumn("path", F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))).withColumn("module", F.lit("pages"))
    parents = line_counts(pages.withColumn("lang", F.lit("HTML")).withColumn("kind", F.lit("parent")), "html")

    def blocks(lang: str, tag: str) -> Column:
        bodies = F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        return F.transform(bodies, lambda body: F.struct(F.lit(lang).alias("lang"), body.alias("body")))

    parts = F.concat(blocks("JavaScript", "script"), blocks("CSS", "style"))
    children = pages.select("path", "module", F.explode(parts).alias("part")).select("path", "module", "part.lang", F.lit("child").alias("kind"), "part.body").where("body <> ''")
    children = line_counts(children, "body").withColumn("bytes", F.lit(0).cast("long")).withColumn("tokens", F.lit(0).cast("long"))
    return parents.select(FILE_COLUMNS).unionByName(children.select(FILE_COLUMNS))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, module, lang, text."""
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("path", document_path())
    return docs.select("path", module_key("path", ROOTS, 2).alias("module"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def tracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracked files: path, module (brand), lines (size x 10)."""
    part = table(spark, sf_dir, "part")
    return part.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("module"), (F.col("p_size") * 10).cast("long").alias("lines"))


# Subjects that stand for the order priorities.
SUBJECTS = {"1-URGENT": "fix(core)!: order {k}", "2-HIGH": "feat: order {k}", "3-MEDIUM": "Add order {k}", "4-NOT SPECIFIED": "order {k} pipeline", "5-LOW": "order {k}"}


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: seq, ts (epoch seconds), author, hash, subject."""
    orders = table(spark, sf_dir, "orders")
    subject = F.lit("order ")
    key = F.col("o_orderkey").cast("string")
    subject = None
    for priority, text in SUBJECTS.items():
        a, b = text.split("{k}")
        made = F.concat(F.lit(a), key, F.lit(b))
        subject = F.when(F.col("o_orderpriority") == priority, made) if subject is None else subject.when(F.col("o_orderpriority") == priority, made)
    kind = F.col("o_custkey") % 5
    domain = F.when(kind == 0, "gmail.com").when(kind == 1, "example.com").otherwise(F.concat(F.lit("team"), (F.col("o_custkey") % 7).cast("string"), F.lit(".dev")))
    return orders.select(
        F.col("o_orderkey").cast("long").alias("seq"),
        epoch_seconds("o_orderdate").alias("ts"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@"), domain).alias("author"),
        key.alias("hash"),
        F.coalesce(subject, F.lit("")).alias("subject"),
    )


def epoch_seconds(name: str):
    return F.expr(f"unix_seconds(cast({name} as timestamp))")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path), each file once a commit."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("seq"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path")).distinct()


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, insertions, deletions) of parts."""
    items = table(spark, sf_dir, "lineitem")
    by_part = items.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("insertions"), F.sum(F.col("l_linenumber").cast("long")).alias("deletions"))
    kind = F.col("l_partkey") % 7
    ext = F.when(kind == 0, "_test.rs").when(kind == 1, ".md").when(kind == 2, ".toml").when(kind == 3, ".py").when(kind == 4, "/lib.rs").when(kind == 5, ".bin").otherwise(".rs")
    return by_part.select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), ext).alias("path"), "insertions", "deletions")


def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("line")).distinct()


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, hits): lines that were returned are covered; accepted ones were never run; others are unknown."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    hit = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long").alias("hits")
    return items.groupBy(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("line")).agg(hit)
