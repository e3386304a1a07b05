"""The adapters' fact tables as DuckDB common table expressions, for the oracle queries."""

from siltstone.sources import rendered

FILES = r"""
doc_lines AS (
  SELECT coalesce(lang, 'und') || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, coalesce(lang, 'und') || '/' || coalesce(source, 'none') AS module,
    coalesce(lang, 'und') AS lang, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), doc_counts AS (
  SELECT path, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN module ELSE lang END AS module, lang, 'parent' AS kind, len(ls)::BIGINT AS lines,
    len(list_filter(ls, lambda x: trim(x, ' ') = ''))::BIGINT AS blanks,
    len(list_filter(ls, lambda x: starts_with(ltrim(x, ' '), '#') OR starts_with(ltrim(x, ' '), '//')))::BIGINT AS comments, octet_length(encode(text))::BIGINT AS bytes FROM doc_lines
), files AS (SELECT path, module, lang, kind, lines - blanks - comments AS code, comments, blanks, lines, bytes, bytes // 4 AS tokens FROM doc_counts)
"""

EMBEDDED = r"""
page_parts AS (
  SELECT 'pages/' || page_id || '.html' AS path, 'HTML' AS lang, 'parent' AS kind, html AS body FROM pages WHERE html IS NOT NULL
  UNION ALL SELECT 'pages/' || page_id || '.html', 'JavaScript', 'child', unnest(regexp_extract_all(html, '(?s)<script(?:\s[^>]*)?>(.*?)</script>', 1)) FROM pages WHERE html IS NOT NULL
  UNION ALL SELECT 'pages/' || page_id || '.html', 'CSS', 'child', unnest(regexp_extract_all(html, '(?s)<style(?:\s[^>]*)?>(.*?)</style>', 1)) FROM pages WHERE html IS NOT NULL
), page_counts AS (
  SELECT path, 'pages' AS module, lang, kind, string_split(body, chr(10)) AS ls, CASE kind WHEN 'parent' THEN octet_length(encode(body))::BIGINT ELSE 0::BIGINT END AS bytes
  FROM page_parts WHERE kind = 'parent' OR body <> ''
), page_sums AS (
  SELECT path, module, lang, kind, len(ls)::BIGINT AS lines, len(list_filter(ls, lambda x: trim(x, ' ') = ''))::BIGINT AS blanks,
    len(list_filter(ls, lambda x: starts_with(ltrim(x, ' '), '#') OR starts_with(ltrim(x, ' '), '//')))::BIGINT AS comments, bytes FROM page_counts
), embedded AS (SELECT path, module, lang, kind, lines - blanks - comments AS code, comments, blanks, lines, bytes, bytes // 4 AS tokens FROM page_sums)
"""

CONTENTS = r"""
contents AS (
  SELECT coalesce(lang, 'und') || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path,
    CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang || '/' || coalesce(source, 'none') ELSE coalesce(lang, 'und') END AS module, coalesce(lang, 'und') AS lang, text
  FROM documents WHERE text IS NOT NULL
)
"""

TRACKED = "tracked AS (SELECT 'part/' || p_partkey AS path, p_brand AS module, (p_size * 10)::BIGINT AS lines FROM part)"

COMMITS = r"""
commits AS (
  SELECT o_orderkey::BIGINT AS seq, epoch(o_orderdate)::BIGINT AS ts,
    'u' || o_custkey || '@' || CASE o_custkey % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'example.com' ELSE 'team' || (o_custkey % 7) || '.dev' END AS author,
    o_orderkey::VARCHAR AS hash,
    coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'fix(core)!: order ' || o_orderkey WHEN '2-HIGH' THEN 'feat: order ' || o_orderkey WHEN '3-MEDIUM' THEN 'Add order ' || o_orderkey
      WHEN '4-NOT SPECIFIED' THEN 'order ' || o_orderkey || ' pipeline' WHEN '5-LOW' THEN 'order ' || o_orderkey END, '') AS subject
  FROM orders
), commit_files AS (SELECT DISTINCT l_orderkey::BIGINT AS seq, 'part/' || l_partkey AS path FROM lineitem)
"""

NUMSTAT = r"""
numstat AS (
  SELECT 'part/' || l_partkey || CASE l_partkey % 7 WHEN 0 THEN '_test.rs' WHEN 1 THEN '.md' WHEN 2 THEN '.toml' WHEN 3 THEN '.py' WHEN 4 THEN '/lib.rs' WHEN 5 THEN '.bin' ELSE '.rs' END AS path,
    sum(trunc(l_quantity)::BIGINT)::BIGINT AS insertions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem GROUP BY l_partkey
)
"""

COVERAGE = r"""
added AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, l_linenumber::BIGINT AS line FROM lineitem),
coverage AS (SELECT l_orderkey::VARCHAR AS path, l_linenumber::BIGINT AS line, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS hits FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
"""


def r(x: str, digits: int = 4) -> str:
    """Round half away from zero, for values of at least 0."""
    return f"floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE"


def ratio(a: str, b: str, digits: int = 4) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE {r(f'({a})::DOUBLE / ({b})::DOUBLE', digits)} END"


def avg_half_up(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE (({a}) + ({b}) // 2) // ({b}) END::BIGINT"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + " "


def code_sql() -> str:
    """The rendered code files: code_files(path, module, lang, text)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def line(x) -> str:
        if isinstance(x, tuple):
            return f"CASE WHEN {rendered.CONDITIONS[x[0]]} THEN {line(x[1])} END"
        return "(" + " || ".join(f"({rendered.NAMES[p]})::VARCHAR" if named else quoted(p) for named, p in rendered.pieces(x)) + ")"

    def pick(key: str, values: list[str]) -> str:
        return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"

    joined = lambda lines: f"concat_ws(chr(10), {', '.join(map(line, lines))})"
    body, head = pick("l_orderkey", [joined(x[3]) for x in rendered.FILES]), pick("o_orderkey", [joined(x[2]) for x in rendered.FILES])
    lang, ext = pick("o_orderkey", [quoted(x[0]) for x in rendered.FILES]), pick("o_orderkey", [quoted(x[1]) for x in rendered.FILES])
    return f"""code_parts AS (SELECT l_orderkey, l_linenumber, {body} AS body FROM lineitem),
      code_bodies AS (SELECT l_orderkey, string_agg(body, chr(10) ORDER BY l_linenumber, body) AS bodies FROM code_parts GROUP BY l_orderkey),
      code_named AS (SELECT {lang} AS lang, {ext} AS ext, o_orderkey AS o, {head} || chr(10) || coalesce(bodies, '') AS text FROM orders LEFT JOIN code_bodies ON o_orderkey = l_orderkey),
      code_files AS (SELECT 'src/' || lower(lang) || '/' || (o % 50) || '/o' || o || '.' || ext AS path, 'src/' || lower(lang) AS module, lang, text FROM code_named)"""


CODE = code_sql()


def locks_sql() -> str:
    """The rendered lockfiles: lock_files(path, text)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    line = lambda x: "(" + " || ".join(f"({rendered.NAMES[p]})::VARCHAR" if named else quoted(p) for named, p in rendered.pieces(x)) + ")"
    pick = lambda key, values: f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
    kinds = rendered.LOCKFILES
    body = pick("o_orderkey", [f"array_to_string(parts, {quoted(x[3])})" for x in kinds])
    return f"""lock_parts AS (SELECT l_orderkey, list(DISTINCT {pick('l_orderkey', [line(x[2]) for x in kinds])}) AS parts FROM lineitem GROUP BY l_orderkey),
      lock_files AS (SELECT 'o' || o_orderkey || '/' || {pick('o_orderkey', [quoted(x[0]) for x in kinds])} AS path, {pick('o_orderkey', [line(x[1]) for x in kinds])} || coalesce({body}, '') || CASE WHEN o_custkey % 2 = 0 THEN {pick('o_orderkey', [quoted(x[4]) for x in kinds])} ELSE '' END AS text
        FROM (SELECT o_orderkey, o_custkey, list_sort(parts) AS parts FROM orders LEFT JOIN lock_parts ON o_orderkey = l_orderkey))"""


LOCKS = locks_sql()
