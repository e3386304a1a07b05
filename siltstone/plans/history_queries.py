"""History queries with their oracle SQL."""

from __future__ import annotations

from siltstone.functions.scalars import FEAT_STARTS, INTENT_PREFIXES, INTENT_WORDS
from siltstone.operators import history as his
from siltstone.plans.facts_sql import COMMITS, TRACKED, r, ratio, with_
from siltstone.plans.inventory_queries import buckets_sql
from siltstone.sources import adapters as src

TOUCHED = "touched AS (SELECT cf.seq, f.path, f.module, f.lines, c.ts, c.author, c.subject FROM commit_files cf JOIN tracked f ON cf.path = f.path JOIN commits c ON cf.seq = c.seq)"
BASE = with_(TRACKED, COMMITS, TOUCHED)
AGES = BASE.rstrip() + """, changes AS (SELECT path, module, max(ts) AS last_change FROM touched GROUP BY 1, 2),
  ages AS (SELECT path, module, ((SELECT max(ts) FROM touched) - last_change) // 86400 AS age_days FROM changes) """


def intent_case() -> str:
    prefix = r"lower(rtrim(regexp_replace(regexp_extract(s, '^([^:(]*)(\([^:]*)?:', 1), '!+$', ''), ' '))"
    out = ["WHEN starts_with(s, 'Revert \"') OR starts_with(s, 'revert:') THEN 'revert'"]
    out += [f"WHEN {prefix} IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in INTENT_PREFIXES]
    for kind, words in INTENT_WORDS:
        cond = f"regexp_matches(lower(s), '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])')"
        cond = f"({cond} OR regexp_matches(lower(s), '{FEAT_STARTS}'))" if kind == "feat" else cond
        out.append(f"WHEN {cond} THEN '{kind}'")
    return "CASE " + " ".join(out) + " ELSE 'other' END"


KIND_SUMS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (intent = '{k}') AS \"{k}\"" for k in his.KINDS)
KIND_COLS = "total, " + ", ".join(f'"{k}"' for k in his.KINDS) + f", {ratio('other', 'total')} AS unknown_pct, {ratio('fix + revert', 'total')} AS corrective_ratio"


def touched(spark, d):
    return his.touches(src.commits(spark, d), src.commit_files(spark, d), src.tracked_files(spark, d))


QUERIES = {
    "hotspots": (lambda s, d: his.hotspots(touched(s, d)), BASE + "SELECT path, lines, count(*) AS commits, (lines * count(*))::BIGINT AS score FROM touched GROUP BY path, lines"),
    "bus_factor": (lambda s, d: his.bus_factor(touched(s, d)), BASE + "SELECT module, count(DISTINCT author) AS authors FROM touched GROUP BY module"),
    "freshness": (
        lambda s, d: his.freshness(touched(s, d)),
        AGES + f"""SELECT module, count(*) AS files, count(*) FILTER (age_days > 365) AS stale_files, {ratio('count(*) FILTER (age_days > 365)', 'count(*)')} AS stale_pct, {ratio('sum(age_days)', 'count(*)', 2)} AS avg_days,
          max(CASE WHEN i = ceil(0.9::DOUBLE * (n - 1)) THEN age_days END) AS p90_days FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY age_days) - 1 AS i, count(*) OVER (PARTITION BY module) AS n FROM ages) GROUP BY module""",
    ),
    "code_age_buckets": (lambda s, d: his.code_age(touched(s, d)), buckets_sql("ages", "age_days", his.AGE_BUCKETS, AGES)),
    "refresh_trend": (
        lambda s, d: his.refresh_trend(touched(s, d)),
        BASE.rstrip() + """, t AS (SELECT path, (SELECT max(ts) FROM touched) - ts AS age FROM touched),
          n AS (SELECT count(DISTINCT path) FILTER (age <= 2592000) AS a, count(DISTINCT path) FILTER (age > 2592000 AND age <= 5184000) AS b FROM t)
          SELECT a AS recent_refreshes, b AS prior_refreshes, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 'rising' ELSE 'flat' END WHEN (a - b)::DOUBLE / b > 0.1 THEN 'rising' WHEN (a - b)::DOUBLE / b < -0.1 THEN 'falling' ELSE 'flat' END AS trend FROM n""",
    ),
    "module_coupling": (
        lambda s, d: his.coupling(touched(s, d)),
        BASE.rstrip() + f""", cm AS (SELECT DISTINCT seq, module FROM touched), per AS (SELECT module, count(*) AS n FROM cm GROUP BY module),
          p AS (SELECT a.module AS left_module, b.module AS right_module, count(*) AS count FROM cm a JOIN cm b ON a.seq = b.seq AND a.module < b.module GROUP BY 1, 2)
          SELECT left_module, right_module, count, l.n AS n_left, q.n AS n_right, {ratio('count', 'l.n + q.n - count')} AS jaccard, {ratio('count * (SELECT count(DISTINCT seq) FROM cm)', 'l.n * q.n')} AS lift
          FROM p JOIN per l ON l.module = left_module JOIN per q ON q.module = right_module""",
    ),
    "commit_intent": (lambda s, d: his.commit_intents(src.commits(s, d)), BASE.rstrip() + f", i AS (SELECT {intent_case()} AS intent FROM (SELECT trim(subject) AS s FROM commits)), k AS (SELECT {KIND_SUMS} FROM i) SELECT {KIND_COLS} FROM k"),
    "module_intent": (
        lambda s, d: his.module_intents(touched(s, d)),
        BASE.rstrip() + f", i AS (SELECT module, {intent_case()} AS intent FROM (SELECT DISTINCT seq, module, trim(subject) AS s FROM touched)), k AS (SELECT module, {KIND_SUMS} FROM i GROUP BY module) SELECT module, {KIND_COLS} FROM k",
    ),
    "predictive_churn": (
        lambda s, d: his.churn(touched(s, d)),
        BASE.rstrip() + f""", w AS (SELECT module, week, count(*) AS n FROM (SELECT DISTINCT module, seq, ts // 604800 AS week FROM touched) GROUP BY 1, 2),
          x AS (SELECT module, week, n, week - min(week) OVER (PARTITION BY module) AS x, max(week) OVER (PARTITION BY module) AS last FROM w),
          s AS (SELECT module, count(*) AS weeks, sum(x) AS sx, sum(n) AS sy, sum(x * n) AS sxy, sum(x * x) AS sxx, sum(n * n) AS syy,
            (sum(CASE WHEN week > last - 4 THEN n ELSE 0 END) - sum(CASE WHEN week <= last - 4 AND week > last - 8 THEN n ELSE 0 END))::BIGINT AS recent_change FROM x GROUP BY module),
          q AS (SELECT *, (weeks * sxy - sx * sy)::DOUBLE AS a, (weeks * sxx - sx * sx)::DOUBLE AS b, (weeks * syy - sy * sy)::DOUBLE AS c FROM s),
          v AS (SELECT *, CASE WHEN weeks < 2 OR b = 0 THEN 0.0::DOUBLE ELSE a / b END AS s, CASE WHEN weeks < 2 OR b = 0 OR c = 0 THEN 0.0::DOUBLE ELSE least(a * a / (b * c), 1.0::DOUBLE) END AS r2 FROM q)
          SELECT module, weeks, CASE WHEN s < 0 THEN 0.0::DOUBLE - ({r('-s')}) ELSE {r('s')} END AS slope, {r('r2')} AS r2, recent_change, CASE WHEN s > 0.01 THEN 'rising' WHEN s < -0.01 THEN 'falling' ELSE 'flat' END AS classification FROM v""",
    ),
    "author_domains": (
        lambda s, d: his.author_domains(src.commits(s, d)),
        BASE.rstrip() + f""", e AS (SELECT lower(split_part(author, '@', 2)) AS d FROM commits WHERE len(string_split(author, '@')) = 2),
          n AS (SELECT CASE WHEN d IN ({', '.join(repr(x) for x in his.PUBLIC_DOMAINS)}) THEN 'public-email' ELSE d END AS domain FROM e WHERE d <> '' AND d NOT IN ('example.com', 'localhost') AND NOT contains(d, 'noreply')),
          k AS (SELECT domain, count(*) AS commits FROM n GROUP BY domain) SELECT domain, commits, {ratio('commits', '(SELECT sum(commits) FROM k)')} AS pct FROM k""",
    ),
}
