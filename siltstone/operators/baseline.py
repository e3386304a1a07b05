"""A captured state of a source tree and what is held against it: digests, metrics, scan bounds, audits and schema diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import col
from siltstone.operators.complexity import LANGS
from siltstone.operators.inventory import digest_tree

# Folders whose files are made by tools.
MADE = [".git/", "target/"]
# Bytes of a file that are read if nothing else is asked for.
FILE_BYTES = 128 * 1024
# Severities that fail and that warn.
FAILING, WARNING = ["critical", "high"], ["medium"]
VULNERABILITIES = "array<struct<advisory:struct<id:string,severity:string,title:string>,package:struct<name:string>>>"


def source_digest(contents: DataFrame, keys: tuple[str, ...] = (), lock: str = "Cargo.lock", made: list[str] = MADE) -> DataFrame:
    """(keys, source_hash, files, lock_hash): a digest over path, length and SHA-256 of each file; contents: (keys, path, text).

    A null text is empty; a row given twice counts once; files below the folders `made` by tools do not count. lock_hash
    is null where no file is named `lock`. Without keys there is one row, also for no files; with keys, one each value.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    own = contents.where(~F.coalesce(F.col("path").rlike("^(?:" + "|".join(x.replace(".", "[.]") for x in made) + ")"), F.lit(False))) if made else contents
    rows = own.select(*keys, "path", F.length(text).alias("n"), F.sha2(text, 256).alias("h"))
    tree = digest_tree(rows.select(*keys, F.concat_ws(":", "path", F.col("n").cast("string"), "h").alias("entry")), keys)
    locks = rows.groupBy(*keys).agg(F.max(F.when(F.col("path") == lock, F.col("h"))).alias("lock_hash"))
    both = tree.join(locks, list(keys)) if keys else tree.crossJoin(locks)
    return both.select(*keys, F.col("hash").alias("source_hash"), F.col("entries").alias("files"), "lock_hash")


def determinism_gate(baseline: DataFrame, current: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, status, expected_hash, actual_hash, differences) of two source digests; a tree without a baseline has no row.

    warn with what differs, else pass. A lock file is only asked for if the baseline had one.
    """
    now = current.select(*keys, F.col("source_hash").alias("actual"), F.col("lock_hash").alias("actual_lock"))
    both = baseline.join(now, list(keys), "left") if keys else baseline.crossJoin(now)
    short = lambda c: F.substring(F.coalesce(col(c), F.lit("none")), 1, 16)
    differ = lambda what, a, b: F.concat(F.lit(f"{what} hash mismatch: expected "), short(a), F.lit(", got "), short(b))
    source = F.when(~F.col("source_hash").eqNullSafe(F.col("actual")), differ("source", "source_hash", "actual"))
    missing = F.when(F.col("actual_lock").isNull(), F.lit("lock file missing (was present in baseline)"))
    lock = F.when(F.col("lock_hash").isNotNull(), missing.when(F.col("actual_lock") != F.col("lock_hash"), differ("lock", "lock_hash", "actual_lock")))
    found = F.array_compact(F.array(source, lock))
    return both.select(*keys, F.when(F.size(found) == 0, "pass").otherwise("warn").alias("status"), F.col("source_hash").alias("expected_hash"), F.col("actual").alias("actual_hash"), found.alias("differences"))


def baseline_metrics(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """One row of a baseline's metrics, from complexity_summary and (code, files) of the whole tree; what is not scored is 0."""
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    both = summary.drop("files").crossJoin(F.broadcast(totals.select(F.col("code").alias("total_code_lines"), F.col("files").alias("total_files"))))
    return both.select(
        zero("total_code_lines", "long"), zero("total_files", "long"), zero("avg_cyclomatic", "double"), zero("max_cyclomatic", "long"), zero("avg_cognitive", "double"), zero("max_cognitive", "long"),
        zero("avg_nesting_depth", "double"), zero("max_nesting_depth", "long"), zero("total_functions", "long").alias("function_count"), zero("avg_function_length", "double"),
    )


def baseline_files(files: DataFrame) -> DataFrame:
    """(path, cyclomatic, cognitive, max_nesting, function_count, max_function_length) of file_complexity; what is not scored is 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return files.select("path", *map(zero, ("cyclomatic", "cognitive", "max_nesting", "function_count", "max_function_length")))


def scan_warnings(files: DataFrame, max_file_bytes: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(ord, warning): what limits of a scan leave out of the files in scored languages; files: (path, lang, bytes)."""
    most = FILE_BYTES if max_file_bytes is None else max_file_bytes
    n = F.coalesce("bytes", F.lit(0))
    scored = files.where(F.lower("lang").isin(LANGS))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    one = scored.agg(F.count("*").alias("all"), total((n > most).cast("long")).alias("clipped"), total(F.greatest(n - most, F.lit(0))).alias("outside"), total(F.least(n, F.lit(most))).alias("read"))
    begin, partial = "complexity scan bounded: ", "; complexity metrics are partial"
    named = f"{'default ' if max_file_bytes is None else ''}max_file_bytes={most}"
    texts = F.array(
        F.when(F.col("clipped") > 0, F.concat(F.lit(begin), F.col("clipped").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(f" eligible file(s) exceed {named}{partial}"))),
        F.when(F.col("read") > max_bytes, F.lit(f"{begin}max_bytes={max_bytes} stops before all eligible complexity files are scanned{partial}")) if max_bytes is not None else F.lit(None).cast("string"),
        F.when(F.col("outside") > 0, F.concat(F.lit(f"{begin}at least "), F.col("outside").cast("string"), F.lit(" byte(s) of eligible source were outside the scanned content window"))),
    )
    return one.select(F.posexplode(texts).alias("ord", "warning")).where("warning is not null")


def audited(audits: DataFrame) -> DataFrame:
    """(path, valid, db_version, found): vulnerabilities read from audit reports (path, text) as VARIANT.

    What is no JSON object, or holds a list of another form, is not valid. An entry without an advisory is none.
    """
    rows = audits.select("path", F.try_parse_json("text").alias("v"))
    found = F.try_variant_get("v", "$.vulnerabilities.list", VULNERABILITIES)
    stated = F.try_variant_get("v", "$.vulnerabilities.list", "variant")
    valid = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)) & (found.isNotNull() | stated.isNull() | F.coalesce(F.schema_of_variant(stated) == "VOID", F.lit(False)))
    listed = F.filter(F.coalesce(found, F.array().cast(VULNERABILITIES)), lambda x: x["advisory"].isNotNull())
    return rows.select("path", valid.alias("valid"), F.try_variant_get("v", "$.database.version", "string").alias("db_version"), listed.alias("found"))


def vulnerabilities(audits: DataFrame) -> DataFrame:
    """(path, id, package, severity, title), one row a vulnerability of a valid report; a severity not stated is unknown."""
    rows = audited(audits).where("valid").select("path", F.explode("found").alias("x"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("path", empty("x.advisory.id").alias("id"), empty("x.package.name").alias("package"), F.coalesce("x.advisory.severity", F.lit("unknown")).alias("severity"), empty("x.advisory.title").alias("title"))


def supply_chain_gate(audits: DataFrame) -> DataFrame:
    """(path, status, vulnerabilities, db_version) of each report: fail if one is critical or high, warn if one is medium; pending if it is not valid."""
    of = lambda names: F.exists("found", lambda x: F.coalesce(F.lower(x["advisory"]["severity"]).isin(names), F.lit(False)))
    status = F.when(~F.col("valid"), "pending").when(of(FAILING), "fail").when(of(WARNING), "warn").otherwise("pass")
    return audited(audits).select("path", status.alias("status"), F.when(F.col("valid"), F.size("found")).otherwise(0).cast("long").alias("vulnerabilities"), F.when(F.col("valid"), F.col("db_version")).alias("db_version"))


def schema_gate(diffs: DataFrame) -> DataFrame:
    """(name, additions, removals, status, summary) of unified diffs (name, text) of a schema file each.

    Removals fail if one takes a line with a "type" away, or if they are more than the additions. An empty diff passes
    without a summary; a null text is a diff that could not be made and is pending.
    """
    lines = F.split("text", "\n")
    added = F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))
    removed = F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))
    rows = diffs.select("name", "text", F.size(added).cast("long").alias("additions"), F.size(removed).cast("long").alias("removals"), F.exists(removed, lambda x: x.contains('"type"')).alias("typed"))
    a, b = F.col("additions"), F.col("removals")
    counted = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    breaks = (b > 0) & (F.col("typed") | (b > a))
    empty = F.trim("text", F.lit(" \t\r\n")) == ""
    summary = F.concat(F.lit("schema: "), F.when(b == 0, F.concat(counted(a, "line"), F.lit(" added (additive only)"))).otherwise(F.concat(counted(a, "addition"), F.lit(", "), counted(b, "removal"), F.when(breaks, " (potential breaking change)").otherwise(""))))
    known = F.col("text").isNotNull()
    return rows.select("name", F.when(known, a).otherwise(0).alias("additions"), F.when(known, b).otherwise(0).alias("removals"), F.when(~known, "pending").when(breaks, "fail").otherwise("pass").alias("status"), F.when(known & ~empty, summary).alias("summary"))
