"""Baseline, determinism, audit and schema queries with their oracle SQL. An order is a source tree: its code file and its lockfile."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import baseline as base
from siltstone.operators import complexity as cx
from siltstone.plans.code_queries import CLASSES, CODE_IDS, COMPLEXITY, RISKS, SUMMARY, TOTALS, code_totals, complexity
from siltstone.plans.facts_sql import CODE, CONTENTS, LOCKS, with_
from siltstone.sources import adapters as src
from siltstone.sources.rendered import code_files, lock_files

# --- digests -------------------------------------------------------------------------------------------------------


def trees(spark, d):
    """repo, o, path, text: lockfiles stand at the root of their tree."""
    code = code_files(spark, d).withColumn("o", F.regexp_extract("path", "o([0-9]+)[.]", 1).cast("long"))
    locks = lock_files(spark, d).select(F.regexp_extract("path", "^o([0-9]+)/", 1).cast("long").alias("o"), F.regexp_extract("path", "/(.*)$", 1).alias("path"), "text")
    return code.select("o", "path", "text").unionByName(locks).select(F.concat(F.lit("r"), F.col("o").cast("string")).alias("repo"), "o", "path", "text")


def changed(files):
    """The trees later: every fifth has a longer code file, every fourth no Cargo.lock, every ninth another, some files in target/."""
    text = F.when((F.col("o") % 5 == 0) & F.col("path").startswith("src/"), F.concat("text", F.lit("\nx"))).when((F.col("o") % 9 == 0) & (F.col("path") == "Cargo.lock"), F.concat("text", F.lit("y"))).otherwise(F.col("text"))
    kept = files.where("not (o % 4 = 0 and path = 'Cargo.lock')").withColumn("text", text)
    return kept.unionByName(kept.withColumn("path", F.concat(F.lit("target/"), "path")))


def gate(spark, d):
    files = trees(spark, d)
    return base.determinism_gate(base.source_digest(files, ("repo",)), base.source_digest(changed(files), ("repo",)), ("repo",)).withColumn("differences", F.array_join("differences", "; "))


def digest_sql(files: str, to: str) -> str:
    """`to`(repo, source_hash, files, lock_hash) of `files`(repo, path, text)."""
    return f"""{to}_e AS (SELECT DISTINCT repo, path || ':' || octet_length(encode(text)) || ':' || sha256(text) AS entry FROM {files}),
      {to}_l AS (SELECT repo, ('0x' || substr(sha256(entry), 1, 5))::BIGINT AS b, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS h, count(*) AS n FROM {to}_e GROUP BY 1, 2),
      {to}_b AS (SELECT repo, b >> 10 AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h, sum(n) AS n FROM {to}_l GROUP BY repo, b >> 10),
      {to}_h AS (SELECT repo, sha256(string_agg(h, chr(10) ORDER BY b)) AS source_hash, sum(n)::BIGINT AS files FROM {to}_b GROUP BY repo),
      {to} AS (SELECT h.repo, source_hash, files, lock_hash FROM {to}_h h LEFT JOIN (SELECT repo, sha256(text) AS lock_hash FROM {files} WHERE path = 'Cargo.lock') k ON h.repo = k.repo)"""


TREES = f"""{CODE}, {LOCKS},
  trees AS (SELECT 'r' || o AS repo, o, path, text FROM (SELECT regexp_extract(path, 'o([0-9]+)[.]', 1)::BIGINT AS o, path, text FROM code_files UNION ALL SELECT regexp_extract(path, '^o([0-9]+)/', 1)::BIGINT, regexp_extract(path, '/(.*)$', 1), text FROM lock_files)),
  later AS (SELECT repo, path, text || CASE WHEN o % 5 = 0 AND starts_with(path, 'src/') THEN chr(10) || 'x' WHEN o % 9 = 0 AND path = 'Cargo.lock' THEN 'y' ELSE '' END AS text FROM trees WHERE NOT (o % 4 = 0 AND path = 'Cargo.lock'))"""

# --- audits, schema diffs ------------------------------------------------------------------------------------------

SEVERITY = "case when l_partkey % 40 = 0 then 'Critical' when l_partkey % 40 = 1 then 'high' when l_partkey % 40 < 6 then 'Medium' else 'low' end"


def audits(spark, d):
    """A report an order; its entries are parts, some without an advisory or a severity, one report in seven is cut short."""
    named = F.concat(F.lit('"id": "A-'), F.col("l_partkey").cast("string"), F.lit('", "title": "t"'), F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.concat(F.lit(', "severity": "'), F.expr(SEVERITY), F.lit('"'))))
    entry = F.concat(F.lit('{"package": {"name": "p'), F.col("l_partkey").cast("string"), F.lit('"}, "advisory": '), F.when(F.col("l_partkey") % 11 == 0, "null").otherwise(F.concat(F.lit("{"), named, F.lit("}"))), F.lit("}"))
    listed = src.table(spark, d, "lineitem").select("l_orderkey", entry.alias("e")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("e"), ", ").alias("es"))
    whole = src.table(spark, d, "orders").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.concat(F.lit('{"database": {"version": "d'), (F.col("o_orderkey") % 3).cast("string"), F.lit('"}, "vulnerabilities": '), F.when(F.col("o_custkey") % 10 == 0, "null").otherwise(F.concat(F.lit('{"list": ['), F.coalesce("es", F.lit("")), F.lit("]}"))), F.when(F.col("o_custkey") % 7 == 0, "").otherwise("}"))
    return whole.select(F.concat(F.lit("a/"), F.col("o_orderkey").cast("string")).alias("path"), text.alias("text"))


AUDITS = f"""au AS (SELECT 'a/' || o_orderkey AS path, o_custkey % 7 = 0 AS bad, o_custkey % 10 = 0 AS none, 'd' || (o_orderkey % 3) AS db, o_orderkey FROM orders),
  vu AS (SELECT path, 'A-' || l_partkey AS id, 'p' || l_partkey AS package, CASE WHEN l_partkey % 13 = 0 THEN 'unknown' ELSE {SEVERITY} END AS severity, 't' AS title FROM au JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT bad AND NOT none AND l_partkey % 11 <> 0)"""


def schema_diffs(spark, d):
    """A diff an order: an item's line is added, or if returned taken away; some are empty and some could not be made."""
    sign = F.when(F.col("l_returnflag") == "R", "-").otherwise("+")
    line = F.concat(sign, F.when(F.col("l_partkey") % 6 == 0, '  "type": "x').otherwise('  "name": "x'), F.col("l_linenumber").cast("string"), F.lit('"'))
    body = src.table(spark, d, "lineitem").select("l_orderkey", line.alias("x")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("x"), "\n").alias("xs"))
    whole = src.table(spark, d, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.when(F.col("o_custkey") % 11 == 0, F.lit(None).cast("string")).when(F.col("o_custkey") % 5 == 0, "\n").otherwise(F.concat(F.lit("--- a/schema.json\n+++ b/schema.json\n@@ -1 +1 @@\n"), "xs", F.lit("\n same")))
    return whole.select(F.col("o_orderkey").alias("name"), text.alias("text"))


MAX_FILE, MAX_ALL = 1500, 10_000

QUERIES = {
    "source_digest": (
        lambda s, d: base.source_digest(src.contents(s, d)),
        with_(CONTENTS, "one AS (SELECT '' AS repo, path, text FROM contents)", digest_sql("one", "dg")) + "SELECT source_hash, files, lock_hash FROM dg",
    ),
    "source_digest_trees": (lambda s, d: base.source_digest(trees(s, d), ("repo",)), with_(TREES, digest_sql("trees", "dg")) + "SELECT * FROM dg"),
    "determinism_gate": (
        gate,
        with_(TREES, digest_sql("trees", "old"), digest_sql("later", "cur"))
        + """SELECT repo, o.source_hash AS expected_hash, c.source_hash AS actual_hash, CASE WHEN o.source_hash = c.source_hash AND o.lock_hash IS NOT DISTINCT FROM c.lock_hash THEN 'pass' ELSE 'warn' END AS status,
          concat_ws('; ', CASE WHEN o.source_hash <> c.source_hash THEN 'source hash mismatch: expected ' || o.source_hash[1:16] || ', got ' || c.source_hash[1:16] END,
            CASE WHEN o.lock_hash IS NOT NULL AND c.lock_hash IS NULL THEN 'lock file missing (was present in baseline)' WHEN o.lock_hash <> c.lock_hash THEN 'lock hash mismatch: expected ' || o.lock_hash[1:16] || ', got ' || c.lock_hash[1:16] END) AS differences
          FROM old o JOIN cur c USING (repo)""",
    ),
    "baseline_metrics": (
        lambda s, d: base.baseline_metrics(cx.complexity_summary(complexity(s, d)), code_totals(s, d)),
        with_(*COMPLEXITY, RISKS, SUMMARY, CODE_IDS, CLASSES, TOTALS)
        + """SELECT tt.code AS total_code_lines, tt.files AS total_files, coalesce(avg_cyclomatic, 0) AS avg_cyclomatic, coalesce(max_cyclomatic, 0)::BIGINT AS max_cyclomatic, coalesce(avg_cognitive, 0) AS avg_cognitive, coalesce(max_cognitive, 0)::BIGINT AS max_cognitive,
          coalesce(avg_nesting_depth, 0) AS avg_nesting_depth, coalesce(max_nesting_depth, 0)::BIGINT AS max_nesting_depth, total_functions AS function_count, avg_function_length FROM sm, tt""",
    ),
    "baseline_files": (
        lambda s, d: base.baseline_files(complexity(s, d)),
        with_(*COMPLEXITY) + "SELECT path, cyclomatic, coalesce(cognitive, 0)::BIGINT AS cognitive, coalesce(max_nesting, 0)::BIGINT AS max_nesting, function_count, max_function_length FROM cx",
    ),
    "scan_warnings": (
        lambda s, d: base.scan_warnings(code_files(s, d).withColumn("bytes", F.octet_length("text")), MAX_FILE, MAX_ALL),
        with_(CODE, "b AS (SELECT octet_length(encode(text)) AS n FROM code_files)", f"w AS (SELECT count(*) AS a, count(*) FILTER (n > {MAX_FILE}) AS c, sum(greatest(n - {MAX_FILE}, 0))::BIGINT AS o, sum(least(n, {MAX_FILE})) AS r FROM b)")
        + f"""SELECT * FROM (SELECT 0 AS ord, 'complexity scan bounded: ' || c || ' of ' || a || ' eligible file(s) exceed max_file_bytes={MAX_FILE}; complexity metrics are partial' AS warning FROM w WHERE c > 0
          UNION ALL SELECT 1, 'complexity scan bounded: max_bytes={MAX_ALL} stops before all eligible complexity files are scanned; complexity metrics are partial' FROM w WHERE r > {MAX_ALL}
          UNION ALL SELECT 2, 'complexity scan bounded: at least ' || o || ' byte(s) of eligible source were outside the scanned content window' FROM w WHERE o > 0)""",
    ),
    "vulnerabilities": (lambda s, d: base.vulnerabilities(audits(s, d)), with_(AUDITS) + "SELECT * FROM vu"),
    "supply_chain_gate": (
        lambda s, d: base.supply_chain_gate(audits(s, d)),
        with_(AUDITS, "vc AS (SELECT path, count(*) AS n, bool_or(lower(severity) IN ('critical', 'high')) AS f, bool_or(lower(severity) = 'medium') AS w FROM vu GROUP BY path)")
        + "SELECT au.path, CASE WHEN bad THEN 'pending' WHEN f THEN 'fail' WHEN w THEN 'warn' ELSE 'pass' END AS status, coalesce(n, 0) AS vulnerabilities, CASE WHEN NOT bad THEN db END AS db_version FROM au LEFT JOIN vc ON vc.path = au.path",
    ),
    "schema_gate": (
        lambda s, d: base.schema_gate(schema_diffs(s, d)),
        """WITH x AS (SELECT l_orderkey AS name, count(*) FILTER (l_returnflag <> 'R') AS a, count(*) FILTER (l_returnflag = 'R') AS b, coalesce(bool_or(l_partkey % 6 = 0) FILTER (l_returnflag = 'R'), false) AS t FROM lineitem GROUP BY 1),
          y AS (SELECT name, o_custkey % 11 = 0 AS none, o_custkey % 5 = 0 AS blank, a, b, b > 0 AND (t OR b > a) AS br FROM x JOIN orders ON o_orderkey = name)
          SELECT name, CASE WHEN none OR blank THEN 0 ELSE a END AS additions, CASE WHEN none OR blank THEN 0 ELSE b END AS removals, CASE WHEN none THEN 'pending' WHEN blank THEN 'pass' WHEN br THEN 'fail' ELSE 'pass' END AS status,
            CASE WHEN none OR blank THEN NULL WHEN b = 0 THEN 'schema: ' || a || ' line' || CASE WHEN a = 1 THEN '' ELSE 's' END || ' added (additive only)'
              ELSE 'schema: ' || a || ' addition' || CASE WHEN a = 1 THEN '' ELSE 's' END || ', ' || b || ' removal' || CASE WHEN b = 1 THEN '' ELSE 's' END || CASE WHEN br THEN ' (potential breaking change)' ELSE '' END END AS summary FROM y""",
    ),
}
