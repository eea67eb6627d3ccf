"""Column expressions on documents, parts, pages, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecensus.functions import classify as C
from codecensus.functions import cvss, evidence, packages, text as T
from codecensus.operators import report as RP
from codecensus.plans.registry import query, table
from codecensus.rules import security as S
from codecensus.session import spread


@query("line_counts", r"""
SELECT doc_id,
  (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END)::BIGINT AS loc,
  len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(ltrim(l), '^(#|//|--|\*|%)')))::BIGINT AS sloc
FROM documents""")
def line_counts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.line_total("text").alias("loc"), T.code_line_total("text").alias("sloc"))


@query("slugs", r"""
WITH p AS (SELECT p_partkey, 'part-' || p_name || '-' || p_brand || '-' || p_type AS raw,
                  repeat(p_name || ' ' || p_brand || '/', 5) AS long FROM part),
s AS (SELECT p_partkey, lower(trim(regexp_replace(raw, '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS a,
             lower(trim(regexp_replace(long, '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS b FROM p)
SELECT p_partkey, a AS short_slug,
  CASE WHEN length(b) > 80 THEN rtrim(left(b, 71), '-') || '-' || left(sha1(b), 8) ELSE b END AS long_slug FROM s""")
def slugs(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.slug(F.lit("part"), "p_name", "p_brand", "p_type").alias("short_slug"),
        T.slug(F.repeat(F.concat("p_name", F.lit(" "), "p_brand", F.lit("/")), 5)).alias("long_slug"))


@query("text_helpers", r"""
SELECT p_partkey,
  array_to_string(list_transform(string_split(trim(regexp_replace(replace(p_name, ' ', '_'), '[-_./]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
  CASE WHEN length(p_name || '  ' || p_brand || ' ' || p_type) - 1 <= 24 THEN p_name || ' ' || p_brand || ' ' || p_type
       ELSE left(p_name || ' ' || p_brand || ' ' || p_type, 23) || '…' END AS short,
  CASE WHEN p_partkey < 1000 THEN p_partkey::VARCHAR ELSE printf('%.1fk', p_partkey / 1000.0) END AS num,
  CASE WHEN p_size * 1000 < 1024 THEN (p_size * 1000)::VARCHAR || 'B' ELSE printf('%.1fKB', p_size * 1000 / 1024.0) END AS bytes,
  CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS top,
  greatest(10, least(40, p_size))::DOUBLE AS clamped
FROM part""")
def text_helpers(spark, d):
    p = table(spark, d, "part")
    whole = F.concat("p_name", F.lit("  "), "p_brand", F.lit(" "), "p_type")
    return p.select(
        "p_partkey", T.title_case(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("title"), T.truncate(whole, 24).alias("short"),
        T.human_number("p_partkey").alias("num"), T.human_bytes(F.col("p_size") * 1000).alias("bytes"),
        T.top_dir(F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))).alias("top"), T.clamp(F.col("p_size"), 10.0, 40.0).alias("clamped"))


@query("common_dirs", r"""
WITH w AS (SELECT source, string_split(lang || '/' || source || '/' || text, '/') AS s FROM documents),
m AS (SELECT source, min(s[:-2]) AS a, max(s[:-2]) AS b FROM w GROUP BY 1)
SELECT source, array_to_string(a[1:len(list_filter(range(1, len(a) + 1), lambda k: a[1:k] = b[1:k]))], '/') AS dir FROM m""")
@query("common_dirs_all", r"""
WITH w AS (SELECT source, string_split(lang || '/' || source || '/' || text, '/') AS s FROM documents),
m AS (SELECT source, min(s[:-2]) AS a, max(s[:-2]) AS b FROM w GROUP BY 1)
SELECT source, array_to_string(a[1:len(list_filter(range(1, len(a) + 1), lambda k: a[1:k] = b[1:k]))], '/') AS dir FROM m""")
def common_dirs(spark, d):
    """Whole texts are the rest of the path."""
    segs = T.dir_segments(F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("text")))
    g = table(spark, d, "documents").groupBy("source").agg(F.min(segs).alias("a"), F.max(segs).alias("b"))
    return g.select("source", T.common_dir(F.col("a"), F.col("b")).alias("dir"))


@query("word_entropy", r"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents),
c AS (SELECT word, unnest(string_split(word, '')) AS ch FROM w WHERE word <> ''),
n AS (SELECT word, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2)
SELECT word, round(-sum(k / length(word) * log2(k / length(word))), 4) + 0 AS entropy FROM n GROUP BY word""")
@query("word_entropy_all", r"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents),
c AS (SELECT word, unnest(string_split(word, '')) AS ch FROM w WHERE word <> ''),
n AS (SELECT word, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2)
SELECT word, round(-sum(k / length(word) * log2(k / length(word))), 4) + 0 AS entropy FROM n GROUP BY word""")
def word_entropy(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", F.round(T.entropy("word"), 4).alias("entropy"))


_LEVELS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}


def _cvss_sql() -> str:
    pick = lambda i, k: f"substr('{_LEVELS[k]}', (((o_orderkey // {[1, 4, 8, 24, 48, 96, 288, 864][i]}) % {len(_LEVELS[k])}) + 1)::INT, 1)"
    cols = ", ".join(f"{pick(i, k)} AS m{k}" for i, k in enumerate(_LEVELS))
    w = lambda k, t: "CASE m" + k + " " + " ".join(f"WHEN '{a}' THEN {b}::DOUBLE" for a, b in t.items()) + " END"
    pr = f"CASE WHEN mS = 'C' THEN {w('PR', cvss.PRIVILEGES_CHANGED)} ELSE {w('PR', cvss.PRIVILEGES_UNCHANGED)} END"
    return f"""
WITH v AS (SELECT o_orderkey, {cols} FROM orders),
x AS (SELECT o_orderkey, mS, 1 - (1 - {w('C', cvss.IMPACT)}) * (1 - {w('I', cvss.IMPACT)}) * (1 - {w('A', cvss.IMPACT)}) AS iss,
  8.22::DOUBLE * {w('AV', cvss.ATTACK_VECTOR)} * {w('AC', cvss.ATTACK_COMPLEXITY)} * {pr} * {w('UI', cvss.USER_INTERACTION)} AS e FROM v),
y AS (SELECT o_orderkey, mS, e, CASE WHEN mS = 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS im FROM x),
z AS (SELECT o_orderkey, im, trunc(least(CASE WHEN mS = 'C' THEN 1.08::DOUBLE * (im + e) ELSE im + e END, 10.0::DOUBLE) * 100000)::BIGINT AS n FROM y),
s AS (SELECT o_orderkey, CASE WHEN im <= 0 THEN 0.0::DOUBLE WHEN n % 10000 = 0 THEN n / 100000.0::DOUBLE ELSE (n // 10000 + 1) / 10.0::DOUBLE END AS score FROM z)
SELECT o_orderkey, round(score, 1) AS score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'info' END AS severity FROM s"""


@query("cvss_scores", _cvss_sql())
def cvss_scores(spark, d):
    k = F.col("o_orderkey")
    parts = [F.concat(F.lit(f"/{m}:"), F.substr(F.lit(v), (F.floor(k / div) % len(v) + 1).cast("int"), F.lit(1)))
             for (m, v), div in zip(_LEVELS.items(), (1, 4, 8, 24, 48, 96, 288, 864))]
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("CVSS:3.1"), *parts).alias("vector"))
    scored = o.select("o_orderkey", cvss.base_score("vector").alias("score"))
    return scored.select("o_orderkey", F.round("score", 1).alias("score"), cvss.severity("score").alias("severity"))


@query("severity_risk", r"""
WITH s AS (SELECT user_id, CASE WHEN value >= 50 THEN 'critical' WHEN value >= 30 THEN 'high' WHEN value >= 15 THEN 'medium' WHEN value >= 5 THEN 'low' ELSE 'info' END AS severity FROM events),
c AS (SELECT user_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
             count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info FROM s GROUP BY 1)
SELECT *, critical * 10 + high * 5 + medium * 2 + low AS risk_score,
  CASE WHEN critical > 0 THEN 'critical' WHEN high >= 3 THEN 'high' WHEN high > 0 OR medium >= 5 THEN 'medium' ELSE 'low' END AS risk_level FROM c""")
def severity_risk(spark, d):
    v = F.col("value")
    sev = F.when(v >= 50, "critical").when(v >= 30, "high").when(v >= 15, "medium").when(v >= 5, "low").otherwise("info")
    return RP.risk(RP.severity_counts(table(spark, d, "events").select("user_id", sev.alias("severity")), ["user_id"]))


_ENV = ("DATABASE_URL", "DB_HOST", "REDIS_PORT", "KAFKA_AUTH", "S3_NAME", "AWS_BUCKET", "SMTP_USER", "OAUTH_ID", "APP_TOKEN", "SENTRY_DSN", "AZURE_ID", "LOG_LEVEL", "X_API_KEY")


@query("env_kinds", f"""
WITH e AS (SELECT p_partkey, ([{', '.join("'" + x + "'" for x in _ENV)}])[(p_partkey % {len(_ENV)} + 1)::INT] || '_' || p_size AS name FROM part)
SELECT p_partkey, name, CASE {' '.join(f"WHEN contains(name, '{n}') THEN '{k}'" for n, k in __import__('codecensus.rules.systems', fromlist=['ENV_KINDS']).ENV_KINDS)} ELSE 'config' END AS kind FROM e""")
def env_kinds(spark, d):
    names = F.array(*[F.lit(x) for x in _ENV])
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("_", F.element_at(names, (F.col("p_partkey") % len(_ENV) + 1).cast("int")), "p_size").alias("name"))
    return p.select("p_partkey", "name", C.env_kind("name").alias("kind"))


_DIRS = ("controllers", "services", "domain", "db", "clients", "pages", "misc", "lib/jobs", "x/graphql")
_NAMES = ("order_router.py", "main.ts", "user_repo.go", "dto.java", "gateway.rb", "Makefile", "test_a.py", "readme.md", "Dockerfile", "a.test.ts", "conf.yaml", "x.unknown")


def _paths_sql() -> str:
    return (f"SELECT p_partkey, ([{', '.join(repr(x) for x in _DIRS)}])[(p_partkey % {len(_DIRS)} + 1)::INT] || '/' || "
            f"([{', '.join(repr(x) for x in _NAMES)}])[(p_size % {len(_NAMES)} + 1)::INT] AS path FROM part")


def _paths(spark, d):
    pick = lambda arr, i: F.element_at(F.array(*[F.lit(x) for x in arr]), (i % len(arr) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat_ws("/", pick(_DIRS, F.col("p_partkey")), pick(_NAMES, F.col("p_size"))).alias("path"))


def _lane_sql(path: str) -> str:
    from codecensus.rules.flows import LANE_DIRS, LANE_FILES

    arms = " ".join(f"WHEN regexp_matches('/' || lower({path}), '{p}') THEN '{lane}'" for p, lane in LANE_DIRS)
    arms += " " + " ".join(f"WHEN regexp_matches(lower(split_part({path}, '/', -1)), '{p}') THEN '{lane}'" for p, lane in LANE_FILES)
    return f"CASE {arms} ELSE 'Application' END"


@query("lanes", f"WITH f AS ({_paths_sql()}) SELECT p_partkey, {_lane_sql('path')} AS lane FROM f")
def lanes(spark, d):
    return _paths(spark, d).select("p_partkey", C.lane("path").alias("lane"))


@query("file_kinds", f"""
WITH f AS ({_paths_sql()}), l AS (SELECT p_partkey, path, split_part(path, '/', -1) AS name, CASE
    WHEN path LIKE '%Makefile' THEN 'Make' WHEN path LIKE '%Dockerfile' THEN 'Dockerfile' WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.ts' THEN 'TypeScript' WHEN path LIKE '%.go' THEN 'Go'
    WHEN path LIKE '%.java' THEN 'Java' WHEN path LIKE '%.rb' THEN 'Ruby' WHEN path LIKE '%.md' THEN 'Markdown' WHEN path LIKE '%.yaml' THEN 'YAML' ELSE 'Unknown' END AS language FROM f)
SELECT p_partkey, language, CASE WHEN name IN ('test_a.py', 'a.test.ts') THEN 'test' WHEN name = 'Dockerfile' THEN 'infra' WHEN name = 'Makefile' THEN 'build'
  WHEN language = 'Markdown' THEN 'docs' WHEN language = 'YAML' THEN 'config' WHEN language = 'Unknown' THEN 'data' ELSE 'source' END AS kind FROM l""")
def file_kinds(spark, d):
    f = _paths(spark, d).select("p_partkey", "path", C.language("path").alias("language"))
    return f.select("p_partkey", "language", C.file_kind("path", "language").alias("kind"))


@query("package_parts", r"""
WITH r AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '>=' || p_size || '.0' WHEN 2 THEN '==' || p_size || '.1' ELSE '~=' || p_size || '.2' END AS version FROM part)
SELECT p_partkey, name, version, regexp_replace(version, '^[~>=]*', '') AS cleaned, CASE WHEN version LIKE '>%' THEN '' ELSE ltrim(version, '=~') END AS exact,
  lower(replace(name, '_', '-')) AS normal, 'pkg:pypi/' || name || CASE WHEN version <> '' THEN '@' || regexp_replace(version, '^[~>=]*', '') ELSE '' END AS purl, version = '' AS unpinned FROM r""")
def package_parts(spark, d):
    s = F.col("p_size")
    v = F.when(s % 4 == 0, "").when(s % 4 == 1, F.concat(F.lit(">="), s, F.lit(".0"))).when(s % 4 == 2, F.concat(F.lit("=="), s, F.lit(".1"))).otherwise(F.concat(F.lit("~="), s, F.lit(".2")))
    raw = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("[extra] "), v, F.lit("; python_version > '3'"))
    p = table(spark, d, "part").select("p_partkey", packages.requirement_parts(raw).alias("r")).select("p_partkey", "r.*")
    return p.select(
        "p_partkey", "name", "version", packages.clean_version("version").alias("cleaned"), packages.exact_version("version").alias("exact"),
        packages.normal_name("name", F.lit("pypi")).alias("normal"), packages.purl("name", "version", F.lit("pypi")).alias("purl"), packages.is_unpinned("version").alias("unpinned"))


@query("routes", r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM u),
n AS (SELECT *, list_filter(parts, lambda s: lower(s) NOT IN ('api','v1','v2','v3','rest','graphql','public','internal')) AS named FROM p),
t AS (SELECT page_id, path, coalesce(named[1], parts[1]) AS seg FROM n)
SELECT page_id, '/base' || path AS route,
  CASE WHEN seg IS NULL THEN 'General' ELSE array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(seg, '[-_./]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') END AS label FROM t""")
def routes(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return p.select("page_id", T.route(F.lit("base/"), "path").alias("route"), RP.resource_label().alias("label"))


# RE2 has no lookahead; the escape signal is spelled with an alternative instead.
_SIGNALS = [p.replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)") for p in S.REGEX_SIGNALS]
DEFINITION_SQL = "(" + " + ".join(f"regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in _SIGNALS) + ") >= 2"


@query("line_predicates", rf"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)
SELECT page_id, count(*) FILTER (regexp_matches(line, '^\s*(#|//|/\*|\*|<!--|--\s|;)')) AS comments, count(*) FILTER ({DEFINITION_SQL}) AS definitions,
  count(*) FILTER (regexp_matches(line, '(?i){S.XML_NAMESPACE_HOSTS}') OR regexp_matches(line, '(?i){S.XML_NAMESPACE_CONTEXT}')) AS namespaces FROM l GROUP BY 1""")
def line_predicates(spark, d):
    counts = lambda name, test: F.size(F.filter("ls", test)).cast("long").alias(name)
    return table(spark, d, "pages").select("page_id", F.split("html", "\n").alias("ls")).select(
        "page_id", counts("comments", evidence.is_comment_line), counts("definitions", evidence.is_pattern_definition), counts("namespaces", evidence.is_xml_namespace))


@query("citations", r"""
WITH c AS (SELECT p_partkey, list_distinct([replace(p_name, ' ', '/') || '.py:' || p_size, p_brand || ': text', replace(p_name, ' ', '/') || '.py:' || p_size || '-' || (p_size + 4), 'a b', replace(p_name, ' ', '/') || '.py:' || p_size]) AS v FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(v, lambda x: regexp_matches(x, '^[\w./\\@+-]+(?::\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*)?$'))), ' ') AS kept FROM c""")
def citations(spark, d):
    file = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit(".py:"), "p_size")
    v = F.array(file, F.concat("p_brand", F.lit(": text")), F.concat(F.lit(" "), file, F.lit("-"), (F.col("p_size") + 4).cast("string")), F.lit("a b"), file)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(evidence.valid_citations(v)), " ").alias("kept"))


@query("table_search", "SELECT * FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring')")
def table_search(spark, d):
    return table(spark, d, "part").where(T.matches_any_text(["p_name", "p_brand", "p_type"], "RING"))


@query("severity_steps", """
SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 WHEN 'click' THEN 3 ELSE 4 END AS rank,
  CASE event_type WHEN 'error' THEN 'medium' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'info' ELSE 'info' END AS milder FROM events""")
def severity_steps(spark, d):
    t = F.col("event_type")
    sev = F.when(t == "error", "high").when(t == "purchase", "critical").when(t == "click", "low").otherwise("info")
    return table(spark, d, "events").select("event_id", C.severity_rank(sev).alias("rank"), C.downgrade(sev).alias("milder"))
