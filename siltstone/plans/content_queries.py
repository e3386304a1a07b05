"""Content and near-duplicate queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import content as con
from siltstone.operators import inventory as inv
from siltstone.operators import near_dup as nd
from siltstone.plans.facts_sql import CONTENTS, FILES, r, ratio, with_
from siltstone.sources import adapters as src
from siltstone.sources.rendered import spread

DUPS = """sized AS (SELECT path, module, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS hash FROM contents WHERE text <> ''),
  dups AS (SELECT *, count(*) OVER (PARTITION BY bytes, hash) AS n, row_number() OVER (PARTITION BY bytes, hash ORDER BY path) AS k FROM sized QUALIFY count(*) OVER (PARTITION BY bytes, hash) > 1)"""
#: Tags that do stand in the texts, beside the usual ones.
TAGS = [*con.TODO_TAGS, "license", "the"]


def page_links(spark, d):
    pages = src.table(spark, d, "pages").where("html is not null")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return pages.select(host.alias("source"), F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^/"]*)'), 1)).alias("target"))


def tag_sql(tag: str) -> str:
    # RE2 has no look-around: pad every delimiter, then count hits that consume one on each side
    return f"len(regexp_extract_all(' ' || regexp_replace(lower(text), '([^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\1', 'g') || ' ', '[^\\p{{L}}\\p{{M}}\\p{{N}}_]{tag.lower()}[^\\p{{L}}\\p{{M}}\\p{{N}}_]'))"


def license_sql() -> str:
    def hits(phrases):
        return "(" + " + ".join("contains(lower(text), '" + p.replace("'", "''") + "')::INT" for p in phrases) + ")"

    options = " UNION ALL ".join(f"SELECT path, '{s}' AS spdx, {k} AS o, {r(f'0.6::DOUBLE + 0.4::DOUBLE * {hits(p)}::DOUBLE / {len(p)}.0::DOUBLE')} AS confidence FROM contents WHERE {hits(p)} >= {n}" for k, (s, n, p) in enumerate(con.LICENSES))
    return with_(CONTENTS) + f"SELECT path, spdx, confidence FROM ({options}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY confidence DESC, o) = 1"


PAIRS = """toks AS (SELECT lang AS scope, path, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: ('0x' || md5(x)[1:15])::BIGINT::HUGEINT) AS t FROM contents),
  grams AS (SELECT scope, path, i, list_reduce(t[i:i + 24], lambda a, b: (a * 1000003 + b) % 2305843009213693951)::BIGINT AS h FROM (SELECT scope, path, t, unnest(range(1, len(t) - 23)) AS i FROM toks WHERE len(t) >= 25)),
  wins AS (SELECT *, min(h) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m, count(*) OVER (PARTITION BY path) AS n FROM grams),
  fps AS (SELECT DISTINCT scope, path, CASE WHEN n < 4 THEN h ELSE m END AS fp FROM wins WHERE n < 4 OR i <= n - 3),
  sizes AS (SELECT scope, path, count(*) AS n FROM fps GROUP BY 1, 2), posts AS (SELECT scope, fp FROM fps GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 50),
  kept AS (SELECT fps.* FROM fps JOIN posts USING (scope, fp)),
  shared AS (SELECT a.scope, a.path AS left_path, b.path AS right_path, count(*) AS shared FROM kept a JOIN kept b ON a.scope = b.scope AND a.fp = b.fp AND a.path < b.path GROUP BY 1, 2, 3),
  pairs AS (SELECT s.scope, left_path, right_path, shared, """ + ratio("shared", "x.n + y.n - shared") + """ AS similarity FROM shared s JOIN sizes x ON x.scope = s.scope AND x.path = left_path JOIN sizes y ON y.scope = s.scope AND y.path = right_path
    WHERE shared::DOUBLE / (x.n + y.n - shared)::DOUBLE >= 0.8::DOUBLE)"""

QUERIES = {
    "exact_duplicates": (lambda s, d: con.duplicate_groups(src.contents(s, d)), with_(CONTENTS, DUPS) + "SELECT hash, bytes, count(*) AS files, (bytes * (count(*) - 1))::BIGINT AS wasted_bytes FROM dups GROUP BY hash, bytes"),
    "duplicate_members": (lambda s, d: con.duplicate_members(src.contents(s, d)), with_(CONTENTS, DUPS) + "SELECT path, module, bytes, hash, k = 1 AS keeper FROM dups"),
    "duplication_density": (
        lambda s, d: con.duplication_density(src.contents(s, d)),
        with_(CONTENTS, DUPS, "tot AS (SELECT module, sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM contents GROUP BY module)",
              "m AS (SELECT module, count(*) AS duplicate_files, count(*) FILTER (k > 1) AS wasted_files, sum(bytes)::BIGINT AS duplicated_bytes, coalesce(sum(bytes) FILTER (k > 1), 0)::BIGINT AS wasted_bytes FROM dups GROUP BY module)")
        + f"SELECT m.*, total_bytes, {ratio('wasted_bytes', 'total_bytes')} AS density FROM m JOIN tot USING (module)",
    ),
    "todo_density": (
        lambda s, d: con.todo_density(src.contents(s, d), inv.totals(src.files(s, d)), TAGS),
        with_(CONTENTS, FILES, "tags AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, coalesce(sum({tag_sql(t)}), 0)::BIGINT AS count FROM contents" for t in TAGS) + ")")
        + f"SELECT tag, count, (SELECT sum(count) FROM tags)::BIGINT AS total, {ratio('(SELECT sum(count) FROM tags) * 1000', '(SELECT sum(code) FROM files)', 2)} AS per_kloc FROM tags",
    ),
    "import_edges": (
        lambda s, d: con.import_edges(page_links(s, d)),
        "SELECT source, target, count(*) AS count FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS source, unnest(regexp_extract_all(html, '<a href=\"(/[^/\"]*)', 1)) AS target FROM pages WHERE html IS NOT NULL) GROUP BY 1, 2",
    ),
    "topic_clouds": (
        lambda s, d: con.topic_clouds(src.files(s, d), src.ROOTS),
        with_(FILES, "terms AS (SELECT path, module, greatest(tokens, 1) AS w, unnest(regexp_split_to_array(lower(path), '[/_\\-.]')) AS term FROM files)",
              f"each_t AS (SELECT * FROM terms WHERE term <> '' AND term NOT IN ({', '.join(repr(x) for x in [*con.TOPIC_STOPS, *con.TOPIC_EXTENSIONS, *src.ROOTS])}))",
              "tf AS (SELECT module, term, sum(w)::BIGINT AS tf FROM each_t GROUP BY 1, 2 UNION ALL SELECT '', term, sum(w)::BIGINT FROM each_t GROUP BY 2)", "df AS (SELECT term, count(DISTINCT path) AS df FROM each_t GROUP BY 1)",
              f"sc AS (SELECT module, term, tf, df, {r('tf * (ln(((SELECT count(DISTINCT module) FROM files) + 1)::DOUBLE / (df + 1)::DOUBLE) + 1.0::DOUBLE)')} AS score FROM tf JOIN df USING (term))")
        + "SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY module ORDER BY score DESC, term) <= 8",
    ),
    "entropy_suspects": (
        lambda s, d: con.entropy_suspects(src.contents(s, d).unionByName(src.table(s, d, "embeddings").select(F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("path"), F.lit("vec").alias("module"), F.lit("vec").alias("lang"), F.repeat(F.lit("ab"), F.col("label") + 1).alias("text")))),
        with_(CONTENTS, "alls AS (SELECT path, module, text FROM contents UNION ALL SELECT 'vec/' || vec_id, 'vec', repeat('ab', label + 1) FROM embeddings)",
              "h AS (SELECT path, module, hex(encode(text)) AS x FROM alls WHERE text <> '')", "smp AS (SELECT path, module, CASE WHEN length(x) <= 2048 THEN x ELSE substr(x, 1, 1024) || substr(x, length(x) - 1023, 1024) END AS x FROM h)",
              "b AS (SELECT path, module, substr(x, 2 * i + 1, 2) AS byte FROM (SELECT *, unnest(range(0, length(x) // 2)) AS i FROM smp))", "c AS (SELECT path, module, byte, count(*) AS c FROM b GROUP BY 1, 2, 3)",
              "e AS (SELECT path, module, sum(c)::BIGINT AS n, sum(floor(c * log2(c) * 1000000.0::DOUBLE + 0.5)::BIGINT) AS s FROM c GROUP BY 1, 2)",
              f"f AS (SELECT path, module, {r('greatest(log2(n::DOUBLE) - s::DOUBLE / 1000000.0::DOUBLE / n::DOUBLE, 0.0)', 3)} AS entropy, n AS sample_bytes FROM e)")
        + "SELECT *, CASE WHEN entropy > 7.5 THEN 'high' WHEN entropy >= 6.5 THEN 'suspicious' ELSE 'low' END AS class FROM f WHERE entropy >= 6.5 OR entropy < 2.0 ORDER BY entropy DESC, path LIMIT 50",
    ),
    "license_findings": (lambda s, d: con.license_findings(src.contents(s, d)), license_sql()),
    "near_dup_pairs": (lambda s, d: nd.pairs(nd.fingerprints(spread(src.contents(s, d), "path"))), with_(CONTENTS, PAIRS) + "SELECT * FROM pairs"),
    "near_dup_clusters": (
        lambda s, d: nd.clusters(nd.pairs(nd.fingerprints(spread(src.contents(s, d), "path")))),
        with_(CONTENTS, PAIRS).replace("WITH ", "WITH RECURSIVE ", 1)
        + """, both_ways AS (SELECT left_path AS a, right_path AS b FROM pairs UNION ALL SELECT right_path, left_path FROM pairs), reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
          lab AS (SELECT a, min(b) AS label FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS degree FROM both_ways GROUP BY a),
          mem AS (SELECT label, count(*) AS files, first(lab.a ORDER BY degree DESC, lab.a) AS representative FROM lab JOIN deg ON lab.a = deg.a GROUP BY label),
          pr AS (SELECT label, count(*) AS pair_count, max(similarity) AS max_similarity FROM pairs JOIN lab ON lab.a = left_path GROUP BY label)
          SELECT label AS cluster, files, representative, pair_count, max_similarity FROM mem JOIN pr USING (label)""",
    ),
    "near_dup_groups": (
        lambda s, d: nd.groups(nd.fingerprints(src.contents(s, d), scope="")).drop("scope"),
        with_(CONTENTS, PAIRS.replace("lang AS scope", "'' AS scope").replace("BETWEEN 2 AND 50", "> 1")).replace("WITH ", "WITH RECURSIVE ", 1)
        + """, all_of AS (SELECT path, list_sort(list(fp)) AS l FROM fps GROUP BY path), reps AS (SELECT path, min(path) OVER (PARTITION BY l) AS representative FROM all_of),
          both_ways AS (SELECT left_path AS a, right_path AS b FROM pairs UNION ALL SELECT right_path, left_path FROM pairs), reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
          SELECT path, representative, label AS "group" FROM reps JOIN (SELECT a, min(b) AS label FROM reach GROUP BY a) ON a = path""",
    ),
    "near_dup_selection": (
        lambda s, d: nd.select_files(src.files(s, d), 100, 4_000, ["*1.txt", "fr/**"]).select("path", "code").unionByName(nd.selection_counts(src.files(s, d), 100, 4_000, ["*1.txt", "fr/**"]).select(F.concat_ws(" ", "eligible_files", "files_skipped", "excluded_by_pattern").alias("path"), F.lit(-1).cast("long").alias("code"))),
        with_(FILES, "ok AS (SELECT path, code, ends_with(path, '1.txt') OR starts_with(path, 'fr/') AS gone FROM files WHERE bytes <= 4000)")
        + "SELECT * FROM (SELECT path, code FROM ok WHERE NOT gone ORDER BY code DESC, path LIMIT 100) UNION ALL SELECT count(*) FILTER (NOT gone) || ' ' || greatest(count(*) FILTER (NOT gone) - 100, 0) || ' ' || count(*) FILTER (gone), -1 FROM ok",
    ),
}
