"""Extraction from documents and pages, and from file texts derived row by row from tables.

Derived texts have one file per table row, so they grow with the tables, and the expected
facts follow from the row's own columns in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions.text import identifier_tokens, singular
from codecensus.operators import infra as I
from codecensus.operators import manifests as M
from codecensus.operators import security as SE
from codecensus.operators import symbols as SY
from codecensus.operators import systems as S
from codecensus.plans.registry import query, table
from codecensus.plans.text_queries import DEFINITION_SQL
from codecensus.rules import secrets as K
from codecensus.rules import systems as R
from codecensus.session import spread, stored

KEYS = ["repo"]


def doc_files(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "text")).select(
        F.col("source").alias("repo"), F.concat(F.lit("d/"), "doc_id", F.lit(".cfg")).alias("path"), F.lit("INI").alias("language"),
        F.lit("config").alias("kind"), "text")


def page_files(spark, d) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "html")).select(
        F.lit("web").alias("repo"), F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("path"), F.lit("HTML").alias("language"),
        F.lit("config").alias("kind"), F.col("html").alias("text"))


def part_files(spark, d, name: Column, text: Column, language: str = "", kind: str = "source") -> DataFrame:
    """One file per part; the brand is the repository."""
    p = spread(table(spark, d, "part"))
    return p.select(
        F.col("p_brand").alias("repo"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"),
        F.lit(language).alias("language"), F.lit(kind).alias("kind"), text.alias("text"))


def fmt(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c for c in cols])


def word() -> Column:
    return F.regexp_replace("p_name", " ", "_")


REPO_SQL = "p_brand AS repo, 'm' || p_partkey || '/"

LINES_SQL = "ln AS (SELECT repo, path, i AS line_no, trim(l, ' ' || chr(9) || chr(13)) AS line FROM (SELECT repo, path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM f))"
DOCS_SQL = "f AS (SELECT source AS repo, 'd/' || doc_id || '.cfg' AS path, text FROM documents)"
PAGES_SQL = "f AS (SELECT 'web' AS repo, 'p/' || page_id || '.html' AS path, html AS text FROM pages)"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _secret_sql() -> str:
    arms = []
    for rule, _, pattern, severity in K.SECRETS:
        p = pattern.replace("(?!ant-)", "")
        extra = " WHERE NOT m LIKE 'sk-ant-%'" if rule == "openai-key" else ""
        arms.append(f"SELECT repo, path, line_no, line, '{rule}' AS rule, '{severity}' AS severity, v FROM (SELECT *, unnest(regexp_extract_all(line, '{_q(p)}', 1)) AS v FROM ln){extra.replace('m LIKE', 'v LIKE')}")
    placeholder = K.PLACEHOLDER.replace(r"|^(.)\1+$", "")
    return f"""
WITH {DOCS_SQL}, {LINES_SQL}, h AS ({' UNION ALL '.join(arms)}),
k AS (SELECT * FROM h WHERE v <> '' AND NOT regexp_matches(v, '{_q(placeholder)}') AND length(replace(v, v[1], '')) > 0 AND NOT regexp_matches(v, '{_q(K.PROSE)}') AND NOT ({DEFINITION_SQL})),
c AS (SELECT v, ch, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS ch FROM (SELECT DISTINCT v FROM k)) WHERE ch <> '' GROUP BY 1, 2),
e AS (SELECT v, -sum(n / length(v) * log2(n / length(v))) AS bits FROM c GROUP BY 1)
SELECT repo, path AS file, line_no::INT AS line, 'CC-SECRET-' || upper(rule) AS identifier, severity, replace(line, v, left(v, 4) || '****') AS snippet
FROM k JOIN e USING (v) WHERE rule <> 'high-entropy' OR bits >= {K.MIN_ENTROPY}"""


@query("secret_scan", _secret_sql())
def secret_scan(spark, d):
    return SE.scan_secrets(doc_files(spark, d), KEYS).select("repo", "file", "line", "identifier", "severity", "snippet")


RULES = (
    {"id": "license-line", "title": "Licence line", "pattern": r"(?i)licen[sc]e|copyright", "severity": "info", "category": "quality"},
    {"id": "mail-address", "title": "Mail address", "pattern": r"[\w.+-]+@[\w-]+\.[a-z]{2,}", "severity": "low", "category": "config"},
    {"id": "inline-script", "title": "Inline script", "pattern": r"<script>", "severity": "medium", "once_per_file": True},
    {"id": "relative-link", "title": "Relative link", "pattern": r'href="/[^"]*"', "severity": "low"},
    {"id": "hex-value", "title": "Hexadecimal value", "pattern": r"\b[0-9a-f]{40}\b", "severity": "high", "category": "secret"},
)


def _rule_sql(cap: int) -> str:
    arms = [f"SELECT repo, path, line_no, line, '{r['id']}' AS rule, '{r['severity']}' AS severity, {1 if r.get('once_per_file') else cap} AS cap, unnest(regexp_extract_all(line, '{_q(r['pattern'])}')) AS m FROM ln" for r in RULES]
    return f"""
WITH f AS (SELECT source AS repo, 'd/' || doc_id || '.cfg' AS path, text FROM documents UNION ALL SELECT 'web', 'p/' || page_id || '.html', html FROM pages),
{LINES_SQL}, h AS (SELECT * FROM ({' UNION ALL '.join(arms)}) WHERE NOT ({DEFINITION_SQL})),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, path, rule ORDER BY line_no) AS rn FROM h)
SELECT repo, path AS file, line_no::INT AS line, 'CC-' || upper(rule) AS identifier, severity, count(*) AS hits FROM n WHERE rn <= cap GROUP BY ALL"""


@query("code_rules_all", _rule_sql(1_000_000_000))
def code_rules_all(spark, d):
    """Every hit of every rule; no cap."""
    f = doc_files(spark, d).unionByName(page_files(spark, d))
    return SE.scan_rules(f, KEYS, RULES).groupBy("repo", "file", "line", "identifier", "severity").agg(F.count(F.lit(1)).alias("hits"))


@query("rule_scan_capped", _rule_sql(5))
def rule_scan_capped(spark, d):
    f = doc_files(spark, d).unionByName(page_files(spark, d))
    return SE.scan_rules(f, KEYS, RULES, max_per_rule=5).groupBy("repo", "file", "line", "identifier", "severity").agg(F.count(F.lit(1)).alias("hits"))


@query("code_rules")
def code_rules(spark, d):
    """All 46 rules over all documents and pages, read as Python and HTML."""
    f = doc_files(spark, d).withColumn("language", F.lit("Python")).unionByName(page_files(spark, d))
    return SE.scan_rules(f, KEYS).groupBy("identifier").agg(F.count(F.lit(1)).alias("findings"))


# Without word boundaries: the SQL dialect counts accented letters as boundaries.
SIGNATURES = (("der", "Der", "database", "Der", r"der\w*"), ("the", "The", "queue", "The", r"the "), ("tok", "Token", "auth", "Token", r"token|secret"),
              ("que", "Que", "cache", "Que", r"quelle|que[.,]"), ("lic", "Licence", "api", "Licence", r"licen[sc]e"))


def _signature_sql() -> str:
    firsts = " UNION ALL ".join(
        f"SELECT repo, path, '{s[0]}' AS id, min(line_no) AS line_no FROM ln WHERE regexp_matches(line, '(?i){s[4]}') GROUP BY 1, 2" for s in SIGNATURES)
    return f"""
WITH {DOCS_SQL}, {LINES_SQL}, a AS ({firsts}),
h AS (SELECT a.repo, a.path, a.id, a.line_no, left(l.line, 160) AS line FROM a JOIN ln l ON l.repo = a.repo AND l.path = a.path AND l.line_no = a.line_no),
j AS (SELECT *, {DEFINITION_SQL} AS def, regexp_matches(line, '^\\s*(#|//|/\\*|\\*|<!--|--\\s|;)') AS com FROM h),
p AS (SELECT repo, path, line_no, bool_or(com) AS prose FROM j GROUP BY 1, 2, 3),
c AS (SELECT repo, path, count(*) FILTER (line <> '') AS n, count(*) FILTER (def) AS k FROM j GROUP BY 1, 2)
SELECT j.repo, j.path AS file, j.id, j.line_no::INT AS line, CASE WHEN p.prose THEN 'mentioned in prose' WHEN def OR (n >= 4 AND k * 3 >= n) THEN 'matches a pattern definition' ELSE '' END AS note
FROM j JOIN p ON p.repo = j.repo AND p.path = j.path AND p.line_no = j.line_no JOIN c ON c.repo = j.repo AND c.path = j.path"""


@query("first_hits", _signature_sql())
def first_hits(spark, d):
    return S.signature_hits(doc_files(spark, d), KEYS, SIGNATURES).select("repo", "file", "id", "line", "note")


@query("systems", _signature_sql().replace("SELECT j.repo, j.path AS file", "SELECT repo, 'ext-' || id AS id, count(*) AS uses, string_agg(file || ':' || line, ' ' ORDER BY file, line) FILTER (rn <= 12) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY file, line) AS rn FROM (SELECT j.repo, j.path AS file", 1)
       + ") WHERE note = '') GROUP BY repo, id")
def systems(spark, d):
    out = S.systems_from_hits(S.signature_hits(doc_files(spark, d), KEYS, SIGNATURES), KEYS)
    return out.select("repo", "id", "uses", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["file"], e["line"].cast("string"))), " ").alias("evidence"))


@query("signature_scan")
def signature_scan(spark, d):
    """All 89 signatures over all documents and pages."""
    hits = S.signature_hits(doc_files(spark, d).unionByName(page_files(spark, d)), KEYS)
    return hits.groupBy("id", "note").agg(F.count(F.lit(1)).alias("files"))


_HOST = r"https?://([a-zA-Z0-9._\-]+\.[a-zA-Z]{2,})"


@query("hosts", f"""
WITH h AS (SELECT lower(regexp_extract(url, '{_HOST}', 1)) AS host, page_id FROM pages),
k AS (SELECT * FROM h WHERE host <> '' AND NOT regexp_matches(host, '(?i){_q(R.LOCAL_HOST)}') AND NOT regexp_matches(host, '(?i){_q(R.DOC_HOST)}')
  AND NOT regexp_matches(replace(host, '.', ''), 'wwwex') AND NOT contains(host, 'than') AND NOT contains(replace(host, '.', ''), 'than'))
SELECT 'ext-host-' || lower(trim(regexp_replace(host, '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS id, host AS name, count(*) AS uses FROM k GROUP BY host""")
def hosts(spark, d):
    f = table(spark, d, "pages").select(F.lit("web").alias("repo"), F.concat(F.lit("u/"), "page_id").alias("path"), F.lit("source").alias("kind"), F.concat(F.lit("a = '"), "url", F.lit("'")).alias("text"))
    known = spark.range(1).select(F.lit("web").alias("repo"), F.explode(F.array(F.lit("wwwex"), F.lit("than"), F.lit("x"))).alias("id"))
    return S.host_systems(S.suppress_known_hosts(S.hosts(f, KEYS), known, KEYS), KEYS).select("id", "name", "uses")


@query("env_vars", r"""
WITH v AS (SELECT p_brand AS repo, p_partkey, unnest([upper(replace(p_type, ' ', '_')) || '_URL', 'DB_' || p_size, 'S3_' || upper(split_part(p_name, ' ', 1))]) AS name FROM part),
w AS (SELECT repo, name, 'm' || p_partkey || '/x.py' AS file FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY file) AS rn FROM w WHERE length(name) >= 3)
SELECT repo, name, CASE WHEN name LIKE 'DB_%' THEN 'database' WHEN name LIKE 'S3_%' THEN 'storage' ELSE 'config' END AS kind, string_agg(file, ' ' ORDER BY file) FILTER (rn <= 10) AS files, count(*) AS n_files FROM r GROUP BY 1, 2""")
def env_vars(spark, d):
    first = F.upper(F.split("p_name", " ")[0])
    text = fmt('import os\na = os.getenv("%s_URL")\nb = process.env.DB_%d\nc = ENV["S3_%s"]\nd = "$PATH"\n', F.upper(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))), "p_size", first)
    out = S.env_vars(part_files(spark, d, F.lit("x.py"), text, "Python"), KEYS)
    return out.select("repo", "name", "kind", F.array_join("files", " ").alias("files"), "n_files")


def py() -> Column:
    return fmt('"""Doc\nimport nothing\n"""\nimport os, lib_%s as alias\nfrom ..pkg%d.mod import Thing\nimport json.tool\ntry:\n    import opt_%s\nexcept ImportError:\n    opt = None\n\n\nclass C%d(Base):\n    def run(self, a: int):\n        pass\n\n\n@router.get("/v1/%s/{id}")\ndef get_%s(id):\n    pass\n\n\n@app.task\ndef job%d():\n    pass\n',
         word(), "p_size", word(), "p_partkey", word(), word(), "p_partkey")


@query("imports_python", rf"""
SELECT {REPO_SQL}x.py' AS file, unnest(['os', 'lib_' || replace(p_name, ' ', '_'), '..pkg' || p_size || '.mod', 'json.tool', 'opt_' || replace(p_name, ' ', '_')]) AS module,
  unnest([4, 4, 5, 6, 8]) AS line, unnest([false, false, true, false, false]) AS relative FROM part""")
def imports_python(spark, d):
    return SY.imports(part_files(spark, d, F.lit("x.py"), py(), "Python"), KEYS).select("repo", "file", "module", "line", "relative")


@query("imports_other", rf"""
WITH p AS (SELECT *, replace(p_name, ' ', '_') AS w FROM part)
SELECT {REPO_SQL}x.ts' AS file, unnest(['react', './' || w, '@scope/' || w || '/x', 'side-' || p_size]) AS module, unnest([1, 2, 4, 5]) AS line, unnest([false, true, false, false]) AS relative FROM p
UNION ALL SELECT {REPO_SQL}x.go', unnest(['fmt', 'github.com/acme/' || w]), unnest([3, 4]), false FROM p
UNION ALL SELECT {REPO_SQL}X.java', unnest(['java.util.List', 'com.acme.' || w || '.*']), unnest([2, 3]), false FROM p
UNION ALL SELECT {REPO_SQL}x.rs', unnest(['serde', w]), unnest([1, 2]), unnest([false, true]) FROM p""")
def imports_other(spark, d):
    ts = fmt("import React from 'react';\nimport { a } from './%s';\n/* import x from 'no'; */\nconst b = require('@scope/%s/x');\nimport 'side-%d';\n", word(), word(), "p_size")
    go = fmt('package main\nimport (\n\t"fmt"\n\tq "github.com/acme/%s"\n)\n', word())
    java = fmt("package com.acme;\nimport java.util.List;\nimport com.acme.%s.*;\nclass X {}\n", word())
    rs = fmt("use serde::Serialize;\nmod %s;\n", word())
    f = part_files(spark, d, F.lit("x.ts"), ts, "TypeScript").unionByName(part_files(spark, d, F.lit("x.go"), go, "Go")).unionByName(
        part_files(spark, d, F.lit("X.java"), java, "Java")).unionByName(part_files(spark, d, F.lit("x.rs"), rs, "Rust"))
    return SY.imports(f, KEYS).select("repo", "file", "module", "line", "relative")


@query("symbols", rf"""
SELECT {REPO_SQL}x.py' AS file, unnest(['C' || p_partkey, 'C' || p_partkey || '.run', 'get_' || replace(p_name, ' ', '_'), 'job' || p_partkey]) AS name,
  unnest(['class', 'method', 'function', 'function']) AS kind, unnest([13, 14, 19, 24]) AS line,
  unnest(['class C' || p_partkey || '(Base)', 'def run(self, a)', 'def get_' || replace(p_name, ' ', '_') || '(id)', 'def job' || p_partkey || '()']) AS signature FROM part
UNION ALL SELECT {REPO_SQL}x.sql', unnest(['t_' || replace(p_name, ' ', '_'), 'f' || p_size]), unnest(['table', 'procedure']), unnest([1, 2]), '' FROM part""")
def symbols(spark, d):
    sql = fmt("CREATE TABLE IF NOT EXISTS t_%s (a int);\ncreate or replace function f%d() returns int;\n", word(), "p_size")
    f = part_files(spark, d, F.lit("x.py"), py(), "Python").unionByName(part_files(spark, d, F.lit("x.sql"), sql, "SQL"))
    return SY.symbols(f, KEYS).select("repo", "file", "name", "kind", "line", "signature")


@query("endpoints", rf"""
WITH p AS (SELECT *, replace(p_name, ' ', '_') AS w FROM part)
SELECT {REPO_SQL}x.py' AS file, 'http' AS kind, 'GET' AS method, '/v1/' || w || '/{{id}}' AS path, 'get_' || w AS handler, 19 AS line, 'router' AS framework FROM p
UNION ALL SELECT {REPO_SQL}x.py', 'event', 'TASK', 'job' || p_partkey, 'job' || p_partkey, 24, 'Celery' FROM p
UNION ALL SELECT {REPO_SQL}x.ts', 'http', 'POST', '/' || w, '', 1, 'Node HTTP' FROM p
UNION ALL SELECT {REPO_SQL}x.go', 'http', 'GET', '/g/' || p_size, '', 2, 'Gin' FROM p""")
def endpoints(spark, d):
    ts = fmt("app.post('/%s', h);\nlog.info('x');\n", word())
    go = fmt('import "github.com/gin-gonic/gin"\nr.GET("/g/%d", h)\n', "p_size")
    f = part_files(spark, d, F.lit("x.py"), py(), "Python").unionByName(part_files(spark, d, F.lit("x.ts"), ts, "TypeScript")).unionByName(part_files(spark, d, F.lit("x.go"), go, "Go"))
    return SY.endpoints(f, KEYS).select("repo", "file", "kind", "method", "path", "handler", "line", "framework")


@query("frameworks", r"""
WITH f AS (SELECT page_id, html AS t FROM pages)
SELECT 'web' AS repo, 'p/' || page_id || '.html' AS path, array_to_string(list_filter([
  CASE WHEN regexp_matches(t, 'Rails|rails') THEN 'Ruby on Rails' END, CASE WHEN contains(t, 'sinatra') THEN 'Sinatra' END, CASE WHEN contains(t, 'track') THEN 'Tracker' END], lambda x: x IS NOT NULL), ',') AS frameworks
FROM f WHERE regexp_matches(t, 'Rails|rails|sinatra|track')""")
def frameworks(spark, d):
    from codecensus.rules.languages import FRAMEWORKS

    rules = [r for r in FRAMEWORKS if r[0] == ("Ruby",)] + [(("Ruby",), "Tracker", "track")]
    out = SY.frameworks(page_files(spark, d).withColumn("language", F.lit("Ruby")), KEYS, rules)
    return out.withColumn("frameworks", F.array_join("frameworks", ","))


@query("entry_files", "SELECT source AS repo, 'd/' || doc_id || '.cfg' AS path FROM documents WHERE regexp_matches(text, '(?i)secret|token')")
def entry_files(spark, d):
    return SY.entry_files(doc_files(spark, d), KEYS, [(("INI",), "(?i)secret|token")])


@query("optional_imports", f"SELECT {REPO_SQL}x.py' AS path, 'opt_' || replace(p_name, ' ', '_') AS name FROM part")
def optional_imports(spark, d):
    return SE.optional_imports(part_files(spark, d, F.lit("x.py"), py(), "Python"), KEYS)


@query("manifest_dependencies", rf"""
WITH p AS (SELECT *, replace(p_name, ' ', '-') AS w FROM part)
SELECT {REPO_SQL}requirements.txt' AS declared_in, 'pypi' AS ecosystem, unnest([w, 'plain']) AS name, unnest(['==' || p_size || '.0', '']) AS version, 'runtime' AS scope FROM p
UNION ALL SELECT {REPO_SQL}package.json', 'npm', unnest(['@s/' || w, 'vite']), unnest(['^' || p_size, '5']), unnest(['runtime', 'dev']) FROM p
UNION ALL SELECT {REPO_SQL}Cargo.toml', 'cargo', unnest([w, 'tokio']), unnest(['1.' || p_size, '2']), unnest(['runtime', 'dev']) FROM p
UNION ALL SELECT {REPO_SQL}go.mod', 'go', unnest(['github.com/a/' || w, 'github.com/c/d']), unnest(['v1.' || p_size || '.0', 'v0.1.0']), 'runtime' FROM p
UNION ALL SELECT {REPO_SQL}pubspec.yaml', 'pub', unnest([w, 'lints']), unnest(['^' || p_size || '.0.0', '2.0.0']), unnest(['runtime', 'dev']) FROM p""")
def manifest_dependencies(spark, d):
    dash = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    texts = {
        "requirements.txt": fmt("# top\n%s[x]==%d.0 # why\n-r base.txt\nplain\n", dash, "p_size"),
        "package.json": fmt('{"name":"n","dependencies":{"@s/%s":"^%d"},"devDependencies":{"vite":"5"}}', dash, "p_size"),
        "Cargo.toml": fmt('[package]\nname = "n"\n[dependencies]\n%s = { version = "1.%d" }\n[dev-dependencies]\ntokio = "2"\n', dash, "p_size"),
        "go.mod": fmt("module m\nrequire (\n\tgithub.com/a/%s v1.%d.0\n\tgithub.com/c/d v0.1.0 // indirect\n)\n", dash, "p_size"),
        "pubspec.yaml": fmt("name: n\ndependencies:\n  %s: ^%d.0.0\ndev_dependencies:\n  lints: 2.0.0\n", dash, "p_size"),
    }
    f = None
    for name, text in texts.items():
        one = part_files(spark, d, F.lit(name), text)
        f = one if f is None else f.unionByName(one)
    return M.declared(M.manifests(f, KEYS), KEYS).select("repo", "declared_in", "ecosystem", "name", "version", "scope")


@query("locked_versions", rf"""
WITH p AS (SELECT *, replace(p_name, ' ', '-') AS w FROM part)
SELECT {REPO_SQL}Cargo.lock' AS declared_in, 'cargo' AS ecosystem, unnest([w, 'b']) AS name, unnest(['1.' || p_size, '2.0']) AS version FROM p
UNION ALL SELECT {REPO_SQL}yarn.lock', 'npm', '@s/' || w, '3.' || p_size FROM p
UNION ALL SELECT {REPO_SQL}go.sum', 'go', 'github.com/a/' || w, 'v1.' || p_size || '.0' FROM p
UNION ALL SELECT {REPO_SQL}package-lock.json', 'npm', w, p_size || '.1.0' FROM p""")
def locked_versions(spark, d):
    dash = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    texts = {
        "Cargo.lock": fmt('[[package]]\nname = "%s"\nversion = "1.%d"\n\n[[package]]\nname = "b"\nversion = "2.0"\n', dash, "p_size"),
        "yarn.lock": fmt('"@s/%s@^3.0":\n  version "3.%d"\n', dash, "p_size"),
        "go.sum": fmt("github.com/a/%s v1.%d.0 h1:x\ngithub.com/a/%s v1.9.9/go.mod h1:y\n", dash, "p_size", dash),
        "package-lock.json": fmt('{"packages":{"":{"name":"r"},"node_modules/%s":{"version":"%d.1.0"}}}', dash, "p_size"),
    }
    f = None
    for name, text in texts.items():
        one = part_files(spark, d, F.lit(name), text)
        f = one if f is None else f.unionByName(one)
    return M.locked(f, KEYS).select("repo", "declared_in", "ecosystem", "name", "version")


@query("infra_facts", rf"""
SELECT {REPO_SQL}Dockerfile' AS file, 'dockerfile' AS what, 'base:' || p_size AS name, (8000 + p_size)::VARCHAR AS detail FROM part
UNION ALL SELECT {REPO_SQL}docker-compose.yml', 'service', unnest(['db', 'svc' || p_size]), unnest(['postgres:' || p_size, '']) FROM part
UNION ALL SELECT {REPO_SQL}main.tf', 'resource', replace(p_name, ' ', '_'), 'aws_s3_bucket' FROM part
UNION ALL SELECT {REPO_SQL}docker-compose.yml', 'system', 'PostgreSQL', 'service db: postgres:' || p_size FROM part""")
def infra_facts(spark, d):
    docker = fmt('FROM base:%d\nEXPOSE %d\nCMD ["x"]\n', "p_size", F.col("p_size") + 8000)
    compose = fmt("services:\n  db:\n    image: postgres:%d\n  svc%d:\n    build: ./a\n    depends_on: [db]\n", "p_size", "p_size")
    tf = fmt('resource "aws_s3_bucket" "%s" {\n}\n', word())
    f = part_files(spark, d, F.lit("Dockerfile"), docker, kind="infra").unionByName(part_files(spark, d, F.lit("docker-compose.yml"), compose, kind="infra")).unionByName(
        part_files(spark, d, F.lit("main.tf"), tf, kind="infra"))
    c, t = stored(I.containers(f, KEYS)), stored(I.terraform(f, KEYS))
    df = I.dockerfiles(f, KEYS).select("repo", "file", F.lit("dockerfile").alias("what"), F.col("base_images")[0].alias("name"), F.col("ports")[0].cast("string").alias("detail"))
    by_file = ["repo", "path"]
    placed = lambda df: df.withColumn("path", F.col("file"))
    sysn = I.image_systems(stored(I.image_uses(placed(c), placed(I.kubernetes(f, KEYS)), placed(t), by_file)), by_file)
    return df.unionByName(c.select("repo", "file", F.lit("service").alias("what"), "name", F.col("image").alias("detail"))).unionByName(
        t.select("repo", "file", F.lit("resource").alias("what"), "name", F.col("type").alias("detail"))).unionByName(
        sysn.select("repo", F.col("path").alias("file"), F.lit("system").alias("what"), "name", F.explode("evidence").alias("e")).select("repo", "file", "what", "name", F.col("e.note").alias("detail")))


@query("identifier_nouns", r"""
WITH u AS (SELECT page_id, unnest(regexp_extract_all(url, '[a-zA-Z]+')) AS t FROM pages),
w AS (SELECT lower(t) AS t FROM u WHERE length(t) >= 3),
s AS (SELECT CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ses' OR t LIKE '%xes' THEN left(t, length(t) - 2)
  WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END AS noun FROM w)
SELECT noun, count(*) AS n FROM s GROUP BY 1""")
def identifier_nouns(spark, d):
    t = table(spark, d, "pages").select(F.explode(identifier_tokens(F.lower("url"))).alias("t"))
    return t.groupBy(singular("t").alias("noun")).agg(F.count(F.lit(1)).alias("n"))


@query("lock_nested", r"""
WITH p AS (SELECT p_brand AS repo, p_partkey AS k, p_size, 1 + p_partkey % 8 AS depth FROM part), l AS (SELECT *, unnest(range(1, 9)) AS n FROM p)
SELECT repo, 'm' || k || '/package-lock.json' AS declared_in, 'l' || n || '-' || k AS name, p_size || '.' || n || '.0' AS version, CASE WHEN n % 2 = 0 THEN 'dev' ELSE 'runtime' END AS scope FROM l WHERE n <= depth""")
def lock_nested(spark, d):
    """Version-1 lockfiles whose packages nest one to eight levels deep."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    inner = F.lit("")
    for n in range(8, 0, -1):
        below = F.when(1 + F.col("p_partkey") % 8 > n, F.concat(F.lit(', "dependencies": {'), inner, F.lit("}"))).otherwise("")
        inner = F.concat(F.lit(f'"l{n}-'), key, F.lit('": {"version": "'), size, F.lit(f'.{n}.0"' + (', "dev": true' if n % 2 == 0 else "")), below, F.lit("}"))
    text = F.concat(F.lit('{"lockfileVersion": 1, "dependencies": {'), inner, F.lit("}}"))
    return M.locked(part_files(spark, d, F.lit("package-lock.json"), text, kind="manifest"), KEYS).select("repo", "declared_in", "name", "version", "scope")
