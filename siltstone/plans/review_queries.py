"""Complexity, review, gate, context and effort queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import context as ctx
from siltstone.operators import effort as eff
from siltstone.operators import gates
from siltstone.operators import history as his
from siltstone.operators import inventory as inv
from siltstone.operators import review as rev
from siltstone.plans.facts_sql import COMMITS, COVERAGE, FILES, NUMSTAT, TRACKED, r, ratio, with_
from siltstone.plans.history_queries import TOUCHED, touched
from siltstone.sources import adapters as src


COMMIT_COUNT = 42
CLI_ROOTS, SCHEMAS = ["part/1"], ["docs/schema.json"]


def contract(spark, d):
    return rev.contracts(src.numstat(spark, d), CLI_ROOTS, SCHEMAS)


CONTRACT = """ct AS (SELECT coalesce(bool_or(regexp_matches(path, '(lib|mod)\\.rs$')), false) AS api_changed, coalesce(bool_or(starts_with(path, 'part/1')), false) AS cli_changed, coalesce(bool_or(path IN ('docs/schema.json')), false) AS schema_changed FROM numstat),
  con AS (SELECT *, api_changed::BIGINT + schema_changed::BIGINT AS breaking_indicators FROM ct)"""
HEALTH = """hx AS (SELECT coalesce(sum((insertions + deletions > 500)::INT), 0)::BIGINT AS big, coalesce(sum(insertions + deletions), 0)::BIGINT AS t, count(*) AS n FROM numstat),
  health AS (SELECT greatest(greatest(100 - 10 * big, 0) - CASE WHEN breaking_indicators > 0 THEN 20 ELSE 0 END, 0)::BIGINT AS score, big AS large_files_touched, CASE WHEN n > 0 THEN t // n ELSE 0 END::BIGINT AS avg_file_size,
    CASE WHEN big > 5 THEN 'critical' WHEN big > 2 THEN 'high' WHEN big > 0 THEN 'medium' ELSE 'low' END AS complexity_indicator FROM hx, con)"""
SURFACE = f"""ch AS (SELECT *, insertions + deletions AS c, row_number() OVER (ORDER BY insertions + deletions DESC) AS k, count(*) OVER () AS n FROM numstat),
  sf AS (SELECT count(*) AS files_changed, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, sum(c)::BIGINT AS c, coalesce(sum(c) FILTER (k <= ceil(0.2::DOUBLE * n)), 0)::BIGINT AS top FROM ch)
  SELECT {COMMIT_COUNT}::BIGINT AS commits, files_changed, insertions, deletions, insertions - deletions AS net_lines, {ratio('c', str(COMMIT_COUNT))} AS churn_velocity, {ratio('top', 'c')} AS change_concentration FROM sf"""


# --- gates: metrics of this engine's own reports, as a JSON receipt -----------------------------------------------


def receipt(spark, d):
    return inv.totals(src.files(spark, d)).select(F.to_json(F.struct(F.struct("*").alias("totals"), F.lit("complete").alias("status"), F.array(F.lit("en"), F.lit("de")).alias("langs"))).alias("receipt"))


POLICY = [
    (1, "code present", "/totals/code", "gt", "0", None, False, "error"), (2, "few files", "/totals/files", "lte", "100", None, False, "warn"), (3, "status", "/status", "eq", "complete", None, False, "error"),
    (4, "status in", "/status", "in", None, ["complete", "partial"], False, "error"), (5, "second lang", "/langs/1", "contains", "d", None, False, "error"), (6, "no secret", "/secret", "exists", None, None, True, "error"),
    (7, "missing", "/totals/none", "lt", "5", None, False, "error"), (8, "not numeric", "/status", "gt", "1", None, True, "error"), (9, "numeric equal", "/totals/files", "ne", "1000.0", None, False, "warn"),
]


def policy(spark, d):
    rules = spark.createDataFrame(POLICY, gates.RULES)
    return gates.evaluate_policy(gates.pointer_metrics(receipt(spark, d), sorted({p[2] for p in POLICY})), rules)


RATCHETS = [("/totals/code", 10.0, None, "error"), ("/totals/bytes", None, 1e12, "error"), ("/totals/lines", 0.0, None, "warn"), ("/totals/none", 5.0, None, "error"), ("/totals/comments", 5.0, None, "error")]


def ratchet(spark, d):
    rules = spark.createDataFrame(RATCHETS, "pointer string, max_increase_pct double, max_value double, level string")
    pointers = [x[0] for x in RATCHETS]
    whole = gates.pointer_metrics(receipt(spark, d), pointers)
    english = inv.totals(src.files(spark, d).where("lang = 'en'")).select(F.to_json(F.struct(F.struct("*").alias("totals"))).alias("receipt"))
    return gates.evaluate_ratchet(rules, gates.pointer_metrics(english, pointers), whole)


def ratchet_sql() -> str:
    rows = []
    for p, inc, most, level in RATCHETS:
        m = p.rsplit("/", 1)[1]
        b, c = ("NULL::DOUBLE", "NULL::DOUBLE") if m == "none" else (f"(SELECT sum({m})::DOUBLE FROM files WHERE lang = 'en')", f"(SELECT sum({m})::DOUBLE FROM files)")
        rows.append(f"SELECT '{p}' AS pointer, '{level}' AS level, {b} AS b, {c} AS c, {inc if inc is not None else 'NULL'}::DOUBLE AS i, {most if most is not None else 'NULL'}::DOUBLE AS m")
    return with_(FILES, "rr AS (" + " UNION ALL ".join(rows) + ")", "pp AS (SELECT *, CASE WHEN b IS NULL OR c IS NULL THEN NULL WHEN b = 0 THEN CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END ELSE (c - b) / abs(b) * 100 END AS p FROM rr)",
                 "ss AS (SELECT *, CASE WHEN c IS NULL THEN 'missing current' WHEN c > m THEN 'above maximum' WHEN i IS NOT NULL AND b IS NULL THEN 'missing baseline' WHEN p > i THEN 'increased' ELSE 'ok' END AS reason FROM pp)") + f"""SELECT pointer, level, b AS baseline_value, c AS current_value,
                 CASE WHEN p = 'inf'::DOUBLE THEN p ELSE {r('p', 2)} END AS change_pct, reason = 'ok' AS passed, reason FROM ss"""


BUDGET = 20_000


def pack_sql(order: str, spread: bool) -> str:
    """The walk as a recursion over ranked rows."""
    walk = "SELECT 0::BIGINT AS k, 0::BIGINT AS used, NULL::VARCHAR AS took UNION ALL SELECT w.k + 1, w.used + CASE WHEN w.used + q.tokens <= {b} THEN q.tokens ELSE 0 END, CASE WHEN w.used + q.tokens <= {b} THEN q.path END FROM {w} w JOIN {q} q ON q.k = w.k + 1"
    base = with_(FILES).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    out = "SELECT path, module, tokens, code, code AS value FROM files WHERE path IN (SELECT took FROM {w} WHERE took IS NOT NULL)"
    if not spread:
        return base + f", q1 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY code DESC, path) AS k FROM files WHERE tokens > 0), w1 AS ({walk.format(b=BUDGET, w='w1', q='q1')}) " + out.format(w="w1") + " UNION ALL SELECT path, module, tokens, code, code FROM files WHERE tokens = 0"
    return base + f""", rr AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY code DESC, path) AS rank FROM files), q1 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rank, module, path) AS k FROM rr WHERE tokens > 0),
      w1 AS ({walk.format(b=int(BUDGET * 0.7), w='w1', q='q1')}), q2 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY code DESC, path) AS k FROM files WHERE tokens > 0 AND path NOT IN (SELECT took FROM w1 WHERE took IS NOT NULL)),
      w2 AS ({walk.format(b=f"({BUDGET} - (SELECT max(used) FROM w1))", w='w2', q='q2')}), ww AS (SELECT took FROM w1 UNION ALL SELECT took FROM w2) """ + out.format(w="ww") + " UNION ALL SELECT path, module, tokens, code, code FROM files WHERE tokens = 0"


def tag_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower('/' || path), '{p}') THEN '{n}'" for n, p in eff.TAGS) + " ELSE 'core' END"


def models_sql() -> str:
    (a, b, c, d), (e, f, g, h) = eff.MODELS["cocomo81"], eff.MODELS["cocomo2"]
    D = "::DOUBLE"
    parts = "SELECT 'cocomo81' AS model, e1 AS e, m1 AS m FROM mm UNION ALL SELECT 'cocomo2', e2, m2 FROM mm UNION ALL SELECT 'ensemble', (e1 + e2) / 2.0::DOUBLE, (m1 + m2) / 2.0::DOUBLE FROM mm"
    return with_(FILES, "kk AS (SELECT sum(code)::DOUBLE / 1000.0::DOUBLE AS k FROM files HAVING sum(code) > 0)", f"ee AS (SELECT {a}{D} * pow(k, {b}{D}) AS e1, {e}{D} * pow(k, {f}{D}) AS e2 FROM kk)", f"mm AS (SELECT *, {c}{D} * pow(e1, {d}{D}) AS m1, {g}{D} * pow(e2, {h}{D}) AS m2 FROM ee)") + f"SELECT model, {r('e', 2)} AS effort_pm, {r('m', 2)} AS months, {r('e / m', 2)} AS staff FROM ({parts})"


def blast(spark, d):
    t = touched(spark, d)
    changed = src.numstat(spark, d).where("insertions > 800").select(F.regexp_extract("path", "^part/[0-9]+", 0).alias("path"))
    return eff.blast_radius(changed, src.tracked_files(spark, d), his.hotspots(t).where("score > 20000"), his.coupling(t).where("lift > 1.0"))


BLAST = """cm AS (SELECT DISTINCT seq, module FROM touched), per AS (SELECT module, count(*) AS n FROM cm GROUP BY module), pr AS (SELECT a.module AS l, b.module AS q, count(*) AS c FROM cm a JOIN cm b ON a.seq = b.seq AND a.module < b.module GROUP BY 1, 2),
  lf AS (SELECT l, q, """ + ratio("c * (SELECT count(DISTINCT seq) FROM cm)", "x.n * y.n") + """ AS lift FROM pr JOIN per x ON x.module = l JOIN per y ON y.module = q), hot AS (SELECT path FROM touched GROUP BY path, lines HAVING lines * count(*) > 20000),
  ins AS (SELECT * FROM tracked WHERE path IN (SELECT regexp_extract(path, '^part/[0-9]+') FROM numstat WHERE insertions > 800)),
  nn AS (SELECT count(*) AS files_touched, count(DISTINCT module) AS modules_touched, (SELECT count(DISTINCT module) FROM tracked) AS am, (SELECT count(*) FROM ins WHERE path IN (SELECT path FROM hot)) AS hotspots_touched,
    (SELECT count(*) FROM lf WHERE lift > 1.0 AND l IN (SELECT module FROM ins) AND q IN (SELECT module FROM ins)) AS coupled_pairs FROM ins)
  SELECT files_touched, modules_touched, hotspots_touched, coupled_pairs, """ + r("least(15.0::DOUBLE * CASE WHEN modules_touched > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 3.0::DOUBLE * CASE WHEN am > 0 THEN modules_touched::DOUBLE / am ELSE 0.0::DOUBLE END + ln(1.0::DOUBLE + files_touched::DOUBLE) + 2.0::DOUBLE * hotspots_touched + 2.0::DOUBLE * coupled_pairs, 100.0::DOUBLE)", 2) + " AS score FROM nn"

QUERIES = {
    "change_surface": (lambda s, d: rev.change_surface(src.numstat(s, d), COMMIT_COUNT), with_(NUMSTAT).rstrip() + ", " + SURFACE),
    "composition": (
        lambda s, d: rev.composition(src.numstat(s, d)),
        with_(NUMSTAT, "kd AS (SELECT CASE WHEN regexp_matches(p, '\\.(rs|js|ts|py)$') THEN CASE WHEN contains(p, 'test') OR contains(p, '_spec') THEN 'test' ELSE 'code' END WHEN ends_with(p, '.md') OR contains(p, '/docs/') THEN 'docs' WHEN regexp_matches(p, '\\.(toml|json|yml|yaml)$') THEN 'config' END AS k FROM (SELECT lower(path) AS p FROM numstat))",
              "nn AS (SELECT " + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}" for k in ("code", "test", "docs", "config")) + " FROM kd)")
        + "SELECT " + ", ".join(f"{ratio(k, 'code + test + docs + config')} AS {k}_pct" for k in ("code", "test", "docs", "config")) + f", CASE WHEN code > 0 THEN {ratio('test', 'code')} WHEN test > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS test_ratio FROM nn",
    ),
    "contracts": (lambda s, d: contract(s, d), with_(NUMSTAT, CONTRACT) + "SELECT * FROM con"),
    "code_health": (lambda s, d: rev.code_health(src.numstat(s, d), contract(s, d)), with_(NUMSTAT, CONTRACT, HEALTH) + "SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM health"),
    "risk_score": (
        lambda s, d: rev.risk(src.numstat(s, d), rev.code_health(src.numstat(s, d), contract(s, d))),
        with_(NUMSTAT, CONTRACT, HEALTH, "hh AS (SELECT count(*) AS n FROM numstat WHERE insertions + deletions > 300)", "sc AS (SELECT n AS hotspots_touched, least(n * 15 + 100 - score, 100)::BIGINT AS score FROM hh, health)")
        + "SELECT *, CASE WHEN score <= 20 THEN 'low' WHEN score <= 50 THEN 'medium' WHEN score <= 80 THEN 'high' ELSE 'critical' END AS level FROM sc",
    ),
    "review_plan": (
        lambda s, d: rev.review_plan(src.numstat(s, d), contract(s, d)),
        with_(NUMSTAT, CONTRACT, "x AS (SELECT path, insertions + deletions AS l, regexp_matches(path, '(lib|mod)\\.rs$') AS api FROM numstat)")
        + """SELECT path, CASE WHEN api THEN 'API surface changed; ' ELSE '' END || l || ' lines changed' AS reason, least(CASE WHEN l > 200 THEN 1 WHEN l > 50 THEN 2 ELSE 3 END, CASE WHEN api THEN 2 ELSE 3 END)::BIGINT AS priority,
          CASE WHEN api THEN 4 ELSE 5 END::BIGINT AS signal_rank, CASE WHEN l > 300 THEN 5 WHEN l > 100 THEN 3 ELSE 1 END::BIGINT AS complexity, l AS lines_changed FROM x""",
    ),
    "diff_coverage": (
        lambda s, d: rev.diff_coverage(src.added_lines(s, d), src.coverage(s, d)),
        with_(COVERAGE, "o AS (SELECT count(*) AS lines_added, count(*) FILTER (coalesce(hits, 0) > 0) AS lines_covered FROM added LEFT JOIN coverage USING (path, line))", f"v AS (SELECT *, {ratio('lines_covered', 'lines_added', 2)} AS coverage FROM o)")
        + "SELECT *, CASE WHEN coverage >= 0.8 THEN 'pass' WHEN coverage >= 0.5 THEN 'warn' ELSE 'fail' END AS status FROM v",
    ),
    "uncovered_hunks": (
        lambda s, d: rev.hunks(rev.uncovered(src.added_lines(s, d), src.coverage(s, d))),
        with_(COVERAGE, "u AS (SELECT path, line FROM added LEFT JOIN coverage USING (path, line) WHERE coalesce(hits, 0) <= 0)", "g AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM u)") + "SELECT path, min(line) AS start_line, max(line) AS end_line FROM g GROUP BY path, g",
    ),
    "gate_policy": (
        policy,
        "SELECT * FROM (VALUES (1, 'code present', '/totals/code', 'error', true), (2, 'few files', '/totals/files', 'warn', (SELECT count(*) FROM documents WHERE text IS NOT NULL) <= 100), (3, 'status', '/status', 'error', true), (4, 'status in', '/status', 'error', true), (5, 'second lang', '/langs/1', 'error', true), (6, 'no secret', '/secret', 'error', true), (7, 'missing', '/totals/none', 'error', false), (8, 'not numeric', '/status', 'error', false), (9, 'numeric equal', '/totals/files', 'warn', (SELECT count(*) FROM documents WHERE text IS NOT NULL) <> 1000)) v(ord, name, pointer, level, passed)",
    ),
    "ratchet": (ratchet, ratchet_sql()),
    "context_greedy": (lambda s, d: ctx.pack_greedy(src.files(s, d), BUDGET), pack_sql("", False)),
    "context_spread": (lambda s, d: ctx.pack_spread(src.files(s, d), BUDGET), pack_sql("", True)),
    "context_policy": (
        lambda s, d: ctx.policies(src.files(s, d), 8_000).select("path", F.array_join("classes", ",").alias("classes"), "policy", "effective_tokens"),
        with_(FILES, "p AS (SELECT path, tokens, CASE WHEN tokens::DOUBLE / greatest(lines, 1) > 50.0 THEN 'data_blob' ELSE '' END AS classes FROM files)")
        + "SELECT path, classes, CASE WHEN tokens <= 1200 THEN 'full' WHEN classes <> '' THEN 'skip' ELSE 'head_tail' END AS policy, CASE WHEN tokens > 1200 AND classes = '' THEN 1200 ELSE tokens END::BIGINT AS effective_tokens FROM p",
    ),
    "token_estimates": (lambda s, d: ctx.token_estimates(src.files(s, d)), with_(FILES) + "SELECT path, (bytes + 4) // 5 AS tokens_min, (bytes + 3) // 4 AS tokens_est, (bytes + 2) // 3 AS tokens_max FROM files"),
    "effort_basis": (lambda s, d: eff.effort_basis(src.files(s, d)), with_(FILES, f"t AS (SELECT {tag_sql()} AS tag, code FROM files)") + f"SELECT tag, count(*) AS files, sum(code)::BIGINT AS code, {ratio('sum(code)', '(SELECT sum(code) FROM t)')} AS pct_of_code FROM t GROUP BY tag"),
    "effort_models": (lambda s, d: eff.effort_models(src.files(s, d)), models_sql()),
    "blast_radius": (blast, with_(TRACKED, COMMITS, TOUCHED, NUMSTAT).rstrip() + ", " + BLAST),
    "eco_label": (lambda s, d: eff.eco_label(src.files(s, d)), with_(FILES, "b AS (SELECT sum(bytes)::BIGINT AS bytes FROM files)") + f"SELECT CASE WHEN bytes <= 1048576 THEN 'A' WHEN bytes <= 10485760 THEN 'B' WHEN bytes <= 52428800 THEN 'C' WHEN bytes <= 209715200 THEN 'D' ELSE 'E' END AS label, bytes, {ratio('bytes', '1048576', 2)} AS megabytes FROM b"),
}
