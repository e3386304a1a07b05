"""Inventory and derived queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.scalars import redact_path, short_hash
from siltstone.operators import inventory as inv
from siltstone.plans.facts_sql import EMBEDDED, FILES, avg_half_up, r, ratio, with_
from siltstone.sources import adapters as src

AGG = "sum(code)::BIGINT AS code, sum(lines)::BIGINT AS lines"
COLS = "code, lines, files, bytes, tokens"


def folded(key: str, rows: str, top: int) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY code DESC, {key}) AS rk FROM {rows}),
    folded AS (SELECT CASE WHEN rk > {top} THEN 'Other' ELSE {key} END AS {key}, sum(code)::BIGINT AS code, sum(lines)::BIGINT AS lines, sum(files)::BIGINT AS files,
      sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens FROM ranked GROUP BY 1)"""


LANG = """langs AS (SELECT lang, sum(code)::BIGINT AS code, sum(lines)::BIGINT AS lines, count(DISTINCT path)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens
  FROM {rows} GROUP BY lang HAVING sum(code) > 0)"""
MODULE = """modules AS (SELECT module, sum(code)::BIGINT AS code, sum(lines)::BIGINT AS lines, count(DISTINCT CASE WHEN kind = 'parent' THEN path END)::BIGINT AS files,
  sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens FROM {rows} GROUP BY module)"""
AVG = f"{avg_half_up('lines', 'files')} AS avg_lines"
SEPARATE = """kids AS (SELECT path, sum(code) AS c, sum(lines) AS l FROM embedded WHERE kind = 'child' GROUP BY path),
  parted AS (SELECT lang, e.path, greatest(code - coalesce(c, 0), 0) AS code, greatest(lines - coalesce(l, 0), 0) AS lines, bytes, tokens FROM embedded e LEFT JOIN kids k ON e.path = k.path WHERE kind = 'parent'
    UNION ALL SELECT lang || ' (embedded)', path, code, lines, 0, 0 FROM embedded WHERE kind = 'child')"""


def grouped(a: str, b: str) -> str:
    one = "SELECT '{s}' AS scope, {k} AS key, sum({a})::BIGINT AS numerator, sum({b})::BIGINT AS denominator FROM files{g}"
    union = " UNION ALL ".join(one.format(s=s, k=k, a=a, b=b, g=g) for s, k, g in (("total", "''", ""), ("lang", "lang", " GROUP BY lang"), ("module", "module", " GROUP BY module")))
    return with_(FILES) + f"SELECT scope, key, numerator, denominator, {ratio('numerator', 'denominator')} AS ratio FROM ({union})"


def distribution_sql(table: str, value: str, ctes: str) -> str:
    return ctes + f"""SELECT count(*) AS count, min(x) AS min, max(x) AS max, {ratio('sum(x)', 'count(*)', 2)} AS mean, {r('median(x)::DOUBLE', 2)} AS median,
      max(CASE WHEN i = ceil(0.9::DOUBLE * (n - 1)) THEN x END) AS p90, max(CASE WHEN i = ceil(0.99::DOUBLE * (n - 1)) THEN x END) AS p99,
      {ratio('sum((2 * (i + 1) - n - 1) * x)', '(count(*) * sum(x))')} AS gini
      FROM (SELECT {value}::BIGINT AS x, row_number() OVER (ORDER BY {value}) - 1 AS i, count(*) OVER () AS n FROM {table}) HAVING count(*) > 0"""


def buckets_sql(table: str, value: str, buckets, ctes: str) -> str:
    names = ", ".join(f"({k}, '{b[0]}', {b[1]}, {b[2] if b[2] is not None else 'NULL'})" for k, b in enumerate(buckets))
    return ctes + f"""SELECT b.k::INTEGER AS bucket_order, b.label, count(f.v)::BIGINT AS files, {ratio('count(f.v)', f'(SELECT count(*) FROM {table})')} AS pct
      FROM (VALUES {names}) b(k, label, lo, hi) LEFT JOIN (SELECT {value} AS v FROM {table}) f ON f.v >= b.lo AND (b.hi IS NULL OR f.v <= b.hi) GROUP BY b.k, b.label"""


def top_sql(where: str, order: str) -> str:
    return with_(FILES) + f"""SELECT path, module, lang, kind, code, comments, blanks, lines, bytes, tokens, doc_pct, bytes_per_line, depth FROM (
      SELECT *, CASE WHEN code + comments > 0 THEN {ratio('comments', 'code + comments')} END AS doc_pct, CASE WHEN lines > 0 THEN {ratio('bytes', 'lines')} END AS bytes_per_line,
      greatest(len(list_filter(string_split(path, '/'), lambda x: x <> '')), 1)::BIGINT AS depth FROM files) WHERE {where} ORDER BY {order} LIMIT 10"""


def labelled(spark, d, quality: int):
    rows, labels = src.files(spark, d), src.table(spark, d, "labels").where(F.col("quality") == quality)
    doc = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long")
    return inv.lang_rows(rows.withColumn("doc_id", doc).join(labels.select("doc_id").distinct(), "doc_id", "left_semi").drop("doc_id"))


SIDES = """sided AS (SELECT l.quality, f.* FROM files f JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON regexp_extract(f.path, '([0-9]+)\\.txt$', 1)::BIGINT = l.doc_id),
  sums AS (SELECT quality, lang, sum(code)::BIGINT AS code, sum(lines)::BIGINT AS lines, count(DISTINCT path)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens
    FROM sided GROUP BY quality, lang HAVING sum(code) > 0),
  old AS (SELECT * FROM sums WHERE quality = 0), new AS (SELECT * FROM sums WHERE quality = 1),
  diffs AS (SELECT coalesce(o.lang, n.lang) AS lang, """ + ", ".join(
    f"coalesce(o.{m}, 0)::BIGINT AS old_{m}, coalesce(n.{m}, 0)::BIGINT AS new_{m}, (coalesce(n.{m}, 0) - coalesce(o.{m}, 0))::BIGINT AS delta_{m}" for m in ("code", "lines", "files", "bytes", "tokens")
) + """ FROM old o FULL OUTER JOIN new n ON o.lang = n.lang
    WHERE """ + " OR ".join(f"coalesce(o.{m}, 0) <> coalesce(n.{m}, 0)" for m in ("code", "lines", "files", "bytes", "tokens")) + ")"

TOTALS = "count(*) AS files, " + ", ".join(f"coalesce(sum({m}), 0)::BIGINT AS {m}" for m in ("code", "comments", "blanks", "lines", "bytes", "tokens"))
TEST_PATH = "CASE WHEN module LIKE '%/src1%' THEN replace(path, 'src1', 'tests') ELSE path END"
INFRA = "lower(lang) IN ('html', 'css')"

QUERIES = {
    "lang_report": (lambda s, d: inv.lang_report(src.files(s, d)), with_(FILES, LANG.format(rows="files")) + f"SELECT lang, {COLS}, {AVG} FROM langs"),
    "lang_report_top2_other": (lambda s, d: inv.lang_report(src.files(s, d), top=2), with_(FILES, LANG.format(rows="files"), folded("lang", "langs", 2)) + f"SELECT lang, {COLS}, {AVG} FROM folded"),
    "lang_children_separate": (lambda s, d: inv.lang_report(src.embedded(s, d), children="separate"), with_(EMBEDDED, SEPARATE, LANG.format(rows="parted")) + f"SELECT lang, {COLS}, {AVG} FROM langs"),
    "lang_children_collapse": (
        lambda s, d: inv.lang_report(src.embedded(s, d)),
        with_(EMBEDDED, "kept AS (SELECT * FROM embedded WHERE kind = 'parent' OR path NOT IN (SELECT path FROM embedded WHERE kind = 'parent'))", LANG.format(rows="kept")) + f"SELECT lang, {COLS}, {AVG} FROM langs",
    ),
    "module_report": (lambda s, d: inv.module_report(src.files(s, d)), with_(FILES, MODULE.format(rows="files")) + f"SELECT module, {COLS}, {AVG} FROM modules"),
    "module_report_top_other": (lambda s, d: inv.module_report(src.files(s, d), top=5), with_(FILES, MODULE.format(rows="files"), folded("module", "modules", 5)) + f"SELECT module, {COLS}, {AVG} FROM folded"),
    "module_report_children": (lambda s, d: inv.module_report(src.embedded(s, d)), with_(EMBEDDED, MODULE.format(rows="embedded")) + f"SELECT module, {COLS}, {AVG} FROM modules"),
    "export_files": (lambda s, d: inv.export_rows(src.files(s, d)), with_(FILES) + "SELECT * FROM files"),
    "export_min_code": (lambda s, d: inv.export_rows(src.files(s, d), min_code=5), with_(FILES) + "SELECT * FROM files WHERE code >= 5"),
    "export_max_rows": (lambda s, d: inv.export_rows(src.files(s, d), max_rows=25), with_(FILES) + "SELECT * FROM files ORDER BY code DESC, path LIMIT 25"),
    "unique_parent_files": (lambda s, d: inv.unique_parent_files(src.embedded(s, d)), with_(EMBEDDED) + "SELECT count(DISTINCT path) AS files FROM embedded WHERE kind = 'parent'"),
    "derived_totals": (lambda s, d: inv.totals(src.files(s, d)), with_(FILES) + f"SELECT {TOTALS} FROM files"),
    "doc_density": (lambda s, d: inv.doc_density(src.files(s, d)), grouped("comments", "code + comments")),
    "whitespace_ratio": (lambda s, d: inv.whitespace(src.files(s, d)), grouped("blanks", "code + comments")),
    "verbosity": (lambda s, d: inv.verbosity(src.files(s, d)), grouped("bytes", "lines")),
    "max_file": (
        lambda s, d: inv.max_files(src.files(s, d)),
        with_(FILES) + """SELECT 'overall' AS scope, '' AS key, path, lines FROM (SELECT *, row_number() OVER (ORDER BY lines DESC, path DESC) AS k FROM files) WHERE k = 1
          UNION ALL SELECT 'lang', lang, path, lines FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY lines DESC, path) AS k FROM files) WHERE k = 1
          UNION ALL SELECT 'module', module, path, lines FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY lines DESC, path) AS k FROM files) WHERE k = 1""",
    ),
    "lang_purity": (
        lambda s, d: inv.lang_purity(src.embedded(s, d).withColumn("kind", F.lit("parent"))),
        with_(EMBEDDED, "by_lang AS (SELECT module, lang, sum(lines)::BIGINT AS lines FROM embedded GROUP BY 1, 2)",
              "rk AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY lines DESC, lang) AS k, count(*) OVER (PARTITION BY module) AS n, sum(lines) OVER (PARTITION BY module) AS total FROM by_lang)")
        + f"SELECT module, n AS lang_count, lang AS dominant_lang, lines AS dominant_lines, {ratio('lines', 'total')} AS dominant_pct FROM rk WHERE k = 1",
    ),
    "polyglot_entropy": (
        lambda s, d: inv.polyglot(src.files(s, d)),
        with_(FILES, "l AS (SELECT lang, sum(code)::BIGINT AS code FROM files GROUP BY lang HAVING sum(code) > 0)", "p AS (SELECT *, code::DOUBLE / (sum(code) OVER ())::DOUBLE AS p, sum(code) OVER () AS total, row_number() OVER (ORDER BY code DESC, lang) AS k FROM l)")
        + f"SELECT count(*) AS lang_count, {r('coalesce(sum(-p * log2(p)), 0.0)')} AS entropy, max(CASE WHEN k = 1 THEN lang END) AS dominant_lang, max(CASE WHEN k = 1 THEN code END) AS dominant_lines, max(CASE WHEN k = 1 THEN {ratio('code', 'total')} END) AS dominant_pct FROM p",
    ),
    "nesting": (
        lambda s, d: inv.nesting(src.files(s, d)),
        with_(FILES, "dep AS (SELECT module, greatest(len(list_filter(string_split(path, '/'), lambda x: x <> '')), 1)::BIGINT AS d FROM files)")
        + f"SELECT 'total' AS scope, '' AS module, max(d) AS max_depth, {ratio('sum(d)', 'count(*)', 2)} AS avg_depth FROM dep UNION ALL SELECT 'module', module, max(d), {ratio('sum(d)', 'count(*)', 2)} FROM dep GROUP BY module",
    ),
    "test_density": (
        lambda s, d: inv.test_density(src.files(s, d).withColumn("path", F.when(F.col("module").contains("/src1"), F.replace("path", F.lit("src1"), F.lit("tests"))).otherwise(F.col("path")))),
        with_(FILES, f"t AS (SELECT code, regexp_matches(lower({TEST_PATH}), '(^|/)(test|tests|spec|specs)(/|$)') AS t FROM files)",
              "s AS (SELECT coalesce(sum(code) FILTER (t), 0)::BIGINT AS test_lines, coalesce(sum(code) FILTER (NOT t), 0)::BIGINT AS prod_lines, count(*) FILTER (t) AS test_files, count(*) FILTER (NOT t) AS prod_files FROM t)")
        + f"SELECT test_lines, prod_lines, test_files, prod_files, {ratio('test_lines', 'test_lines + prod_lines')} AS ratio FROM s",
    ),
    "boilerplate": (
        lambda s, d: inv.boilerplate(src.embedded(s, d).withColumn("kind", F.lit("parent"))),
        with_(EMBEDDED, f"s AS (SELECT coalesce(sum(lines) FILTER ({INFRA}), 0)::BIGINT AS infra_lines, coalesce(sum(lines) FILTER (NOT {INFRA}), 0)::BIGINT AS logic_lines, string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER ({INFRA}) AS infra_langs FROM embedded)")
        + f"SELECT infra_lines, logic_lines, infra_langs, {ratio('infra_lines', 'infra_lines + logic_lines')} AS ratio FROM s",
    ),
    "distribution": (lambda s, d: inv.distribution(src.files(s, d)), distribution_sql("files", "lines", with_(FILES))),
    "distribution_bytes": (lambda s, d: inv.distribution(src.files(s, d), "bytes"), distribution_sql("files", "bytes", with_(FILES))),
    "size_histogram": (lambda s, d: inv.size_histogram(src.files(s, d)), buckets_sql("files", "lines", inv.SIZE_BUCKETS, with_(FILES))),
    "top_largest_lines": (lambda s, d: inv.top_offenders(src.files(s, d), "largest_lines"), top_sql("true", "lines DESC, path")),
    "top_largest_tokens": (lambda s, d: inv.top_offenders(src.files(s, d), "largest_tokens"), top_sql("true", "tokens DESC, path")),
    "top_largest_bytes": (lambda s, d: inv.top_offenders(src.files(s, d), "largest_bytes"), top_sql("true", "bytes DESC, path")),
    "top_least_documented": (lambda s, d: inv.top_offenders(src.files(s, d), "least_documented"), top_sql("lines >= 50 AND doc_pct IS NOT NULL", "doc_pct, lines DESC, path")),
    "top_most_dense": (lambda s, d: inv.top_offenders(src.files(s, d), "most_dense"), top_sql("lines >= 10 AND bytes_per_line IS NOT NULL", "bytes_per_line DESC, path")),
    "reading_time": (lambda s, d: inv.reading_time(src.files(s, d)), with_(FILES) + f"SELECT {ratio('sum(code)', '20', 2)} AS minutes, 20::BIGINT AS lines_per_minute, sum(code)::BIGINT AS basis_lines FROM files"),
    "context_window_fit": (lambda s, d: inv.context_window(src.files(s, d)), with_(FILES) + f"SELECT 128000::BIGINT AS window_tokens, sum(tokens)::BIGINT AS total_tokens, {ratio('sum(tokens)', '128000')} AS pct, sum(tokens) <= 128000 AS fits FROM files"),
    "cocomo81": (
        lambda s, d: inv.cocomo(src.files(s, d)),
        with_(FILES, "k AS (SELECT sum(code)::DOUBLE / 1000.0::DOUBLE AS kloc FROM files HAVING sum(code) > 0)", "e AS (SELECT kloc, 2.4::DOUBLE * pow(kloc, 1.05::DOUBLE) AS e FROM k)", "t AS (SELECT *, 2.5::DOUBLE * pow(e, 0.38::DOUBLE) AS t FROM e)")
        + f"SELECT {r('kloc')} AS kloc, {r('e', 2)} AS effort_pm, {r('t', 2)} AS duration_months, {r('e / t', 2)} AS staff FROM t",
    ),
    "integrity_digest": (
        lambda s, d: inv.integrity(src.files(s, d)),
        with_(FILES, "e AS (SELECT path || ':' || bytes || ':' || lines AS entry FROM files)", "l AS (SELECT ('0x' || substr(sha256(entry), 1, 5))::BIGINT AS b, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS h, count(*) AS n FROM e GROUP BY 1)", "b AS (SELECT b >> 10 AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h, sum(n) AS n FROM l GROUP BY b >> 10)")
        + "SELECT 'sha256' AS algo, sha256(string_agg(h, chr(10) ORDER BY b)) AS hash, sum(n)::BIGINT AS entries FROM b",
    ),
    "lang_diff": (lambda s, d: inv.lang_diff(labelled(s, d, 0), labelled(s, d, 1)), with_(FILES, SIDES) + "SELECT * FROM diffs"),
    "lang_diff_totals": (
        lambda s, d: inv.diff_totals(inv.lang_diff(labelled(s, d, 0), labelled(s, d, 1))),
        with_(FILES, SIDES) + "SELECT " + ", ".join(f"coalesce(sum({p}_{m}), 0)::BIGINT AS {p}_{m}" for m in ("code", "lines", "files", "bytes", "tokens") for p in ("old", "new", "delta")) + " FROM diffs",
    ),
    "path_tree": (
        lambda s, d: inv.path_tree(src.files(s, d)),
        with_(FILES, "p AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p, lines, tokens FROM files)", "n AS (SELECT unnest(range(1, len(p) + 1)) AS k, p, lines, tokens FROM p)")
        + "SELECT array_to_string(p[1:k], '/') AS node, k::INTEGER AS depth, count(*) AS files, sum(lines)::BIGINT AS lines, sum(tokens)::BIGINT AS tokens FROM n GROUP BY 1, 2",
    ),
    "redact_paths": (
        lambda s, d: src.files(s, d).select(redact_path("path").alias("path"), short_hash("module").alias("module"), "lang", "code"),
        with_(FILES) + "SELECT substr(sha256(path), 1, 16) || '.txt' AS path, substr(sha256(module), 1, 16) AS module, lang, code FROM files",
    ),
}
