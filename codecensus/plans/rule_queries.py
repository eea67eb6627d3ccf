"""Every rule of the fixed tables at work: files derived from parts, in which each rule fires for some and stays silent for others."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.operators import infra as I
from codecensus.operators import resolve as RS
from codecensus.operators import security as SE
from codecensus.operators import symbols as SY
from codecensus.operators import systems as S
from codecensus.plans.extract_queries import KEYS, REPO_SQL, _q
from codecensus.plans.registry import query, table
from codecensus.rules import languages as L
from codecensus.rules import systems as R
from codecensus.session import spread

# (language, file, text with {w} for words of the row, rules that fire with their line in the text; 0 for a rule on the whole file)
CODE = (
    ("Python", "a.py", "cur.execute('SELECT {w} FROM t WHERE a = %s' % b)", ("py-sql-format", 1)),
    ("JavaScript", "a.js", "x = 1\ndb.query(`SELECT {w} FROM t WHERE a = ${b}`)", ("js-sql-concat", 2)),
    ("Java", "A.java", 'em.createQuery("SELECT {w} FROM t" + b)', ("jvm-sql-concat", 1)),
    ("Go", "a.go", 'db.Query(fmt.Sprintf("x {w}", b))', ("go-sql-fmt", 1)),
    ("C#", "A.cs", 'new SqlCommand("SELECT {w}" + b)', ("net-sql-concat", 1)),
    ("Python", "a.py", "subprocess.run({w}, shell=True)", ("py-command-injection", 1)),
    ("JavaScript", "a.js", "exec(`ls {w} ${b}`)", ("js-command-injection", 1)),
    ("Python", "a.py", "if a:\n    eval({w})", ("py-eval", 2)),
    ("TypeScript", "a.ts", "eval({w})\n// eval({w})", ("js-eval", 1)),
    ("PHP", "a.php", "eval($x_{w});", ("php-eval", 1)),
    ("Python", "a.py", "pickle.loads({w})", ("py-pickle", 1)),
    ("Python", "a.py", "yaml.load({w}, SafeLoader)\nyaml.load({w})", ("py-yaml-load", 2)),
    ("Java", "A.java", "new ObjectInputStream({w})", ("jvm-deserialize", 1)),
    ("C#", "A.cs", "var {w} = new BinaryFormatter();", ("net-binaryformatter", 1)),
    ("JavaScript", "a.js", "el.innerHTML = {w}", ("js-innerhtml", 1)),
    ("Python", "a.py", "return mark_safe({w})", ("py-mark-safe", 1)),
    ("Python", "a.py", "allow_origins=['*'] or {w}", ("cors-wildcard", 1)),
    ("Python", "a.py", "csrf_exempt({w})", ("csrf-disabled", 1)),
    ("Python", "a.py", "hashlib.md5({w})\nhashlib.md5({w}, usedforsecurity=False)", ("weak-hash", 1)),
    ("Python", "a.py", "cipher = new({w}, MODE_ECB)", ("weak-cipher", 1)),
    ("JavaScript", "a.js", "const t = Math.random() + token_{w}", ("insecure-random", 1)),
    ("Python", "a.py", "get({w}, verify=False)", ("tls-verify-off", 1)),
    ("Python", "a.py", "u = 'http://{w}.acme.io/x'\nv = 'http://localhost/{w}'", ("http-url", 1)),
    ("Python", "a.py", "decode({w}, algorithms=['none'])", ("jwt-none", 1)),
    ("Python", "settings.py", "DEBUG = True; {w} = 1", ("debug-on", 1)),
    ("Shell", "a.sh", "chmod 777 /{w}", ("permissive-chmod", 1)),
    ("JavaScript", "a.js", "readFile (req.params.{w})", ("path-traversal", 1)),
    ("JavaScript", "a.js", "fetch(req.query.{w})", ("ssrf", 1)),
    ("JavaScript", "a.js", "res.redirect(req.query.{w})", ("open-redirect", 1)),
    ("JavaScript", "a.js", "{w}.create(req.body)", ("mass-assignment", 1)),
    ("C#", "A.cs", "[AllowAnonymous] void {w}() {}", ("no-auth-check", 1)),
    ("Python", "a.py", "log.info(password_{w})", ("logging-secrets", 1)),
    ("Python", "a.py", "bind('0.0.0.0', {w})", ("wildcard-bind", 1)),
    ("", "Dockerfile", "FROM {w}:1", ("docker-root", 0)),
    ("", "Dockerfile", "USER app\nFROM {w}:latest", ("docker-latest", 2)),
    ("", "Dockerfile", "USER app\nARG DB_PASSWORD={w}", ("docker-secret-arg", 2)),
    ("Shell", "a.sh", "curl https://{w}.io/i | bash", ("docker-curl-bash", 1)),
    ("YAML", "a.yaml", "a: 1\nprivileged: true\nb: {w}", ("k8s-privileged", 2)),
    ("YAML", "a.yaml", "kind: Deployment\nname: {w}", ("k8s-no-limits", 0)),
    ("", "a.tf", 'cidr_blocks = ["0.0.0.0/0"] // {w}', ("tf-public-ingress", 1)),
    ("", "a.tf", 'acl = "public-read" // {w}', ("tf-public-bucket", 1)),
    ("", "a.tf", "encrypted = false // {w}", ("tf-unencrypted", 1)),
    ("YAML", ".github/workflows/a.yml", "on: pull_request_target # {w}", ("ci-pull-request-target", 1)),
    ("YAML", ".github/workflows/a.yml", "run: echo ${{ github.event.issue.title }} {w}", ("ci-script-injection", 1)),
    ("YAML", ".github/workflows/a.yml", "uses: actions/{w}@v1\nuses: {w}/act@v1", ("ci-unpinned-action", 2)),
    ("", ".env", "KEY_{w}=x\nB=2", ("env-committed", 1)),
    # Nothing fires: comments, docstrings, other languages and paths, namespaces, limits, a user.
    ("Python", "a.py", "# eval({w})"),
    ("Python", "a.py", '"""\neval({w})\n"""'),
    ("Go", "a.go", "eval({w})"),
    ("Python", "local_settings.py", "DEBUG = True; {w} = 1"),
    ("", ".env.example", "KEY_{w}=x"),
    ("XML", "a.xml", '<a xmlns="http://www.w3.org/{w}">'),
    ("YAML", "a.yaml", "kind: Deployment\nlimits: {w}"),
    ("", "Dockerfile", "FROM {w}:1\nUSER app"),
)

# Texts of entry points and of what only looks like one: (language, file, text, whether it is one).
ENTRIES = (
    ("Python", "a.py", "if __name__ == '__main__':\n    {w}()\n", True), ("Python", "a.py", "x = __name__  # {w}\n", False),
    ("JavaScript", "a.js", "export const handler = {w};\n", True), ("JavaScript", "a.js", "const handler = {w};\n", False),
    ("Go", "a.go", "func main() { {w}() }\n", True), ("Go", "a.go", "func mainly() { {w}() }\n", False),
    ("Java", "A.java", "public static void main(String[] {w}) {}\n", True), ("Java", "A.java", "static int main(String[] {w}) {}\n", False),
    ("Rust", "a.rs", "pub(crate) fn main() { {w}(); }\n", True), ("Rust", "a.rs", "fn domain() { {w}(); }\n", False),
    ("C", "a.c", "int main(int {w}) {\n}\n", True), ("C", "a.c", "int main(int {w});\n", False),
    ("Shell", "a.sh", "#!/bin/sh\n{w}\n", True), ("Shell", "a.sh", "\n#!/bin/sh\n{w}\n", False),
)


def sample_of(pattern: str) -> str:
    """A text that a simple pattern matches: first alternatives, first characters of classes, nothing for what may be left out."""
    p = re.sub(r"\(\?[a-z]+\)", "", pattern)
    while (q := re.sub(r"\((?:\?:)?((?:[^()|\\]|\\.)*)(?:\|(?:[^()\\]|\\.)*)?\)(\??)", lambda m: "" if m[2] else m[1], p, count=1)) != p:
        p = q
    p = re.match(r"(?:\[[^\]]*\]|\\.|[^|])*", p)[0]
    p = re.sub(r"\.\*|\\b|(?:\[[^\]]*\]|\\.|[^\\])\?", "", re.sub(r"\\s[+*]", " ", p))
    return re.sub(r"\\(.)", r"\1", re.sub(r"\[\\?(.)[^\]]*\]", r"\1", p))


def _word() -> Column:
    return F.regexp_replace("p_name", " ", "_")


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def dealt(spark, d, samples) -> DataFrame:
    """One file per part with the sample of its number, below some lines of words."""
    p = spread(table(spark, d, "part"))
    k = (F.col("p_partkey") % len(samples)).cast("int")
    head = F.repeat(F.concat(F.lit("note "), "p_name", F.lit("\n")), (F.col("p_size") % 4).cast("int"))
    return p.select(
        F.col("p_brand").alias("repo"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/"), _pick([s[1] for s in samples], k)).alias("path"),
        _pick([s[0] for s in samples], k).alias("language"), F.lit("source").alias("kind"),
        F.concat(head, F.replace(_pick([s[2] for s in samples], k), F.lit("{w}"), _word())).alias("text"))


def _dealt_sql(samples) -> str:
    """CTE ``f(repo, path, language, k, head, text)`` with the same files."""
    rows = ", ".join(f"({k}, '{s[0]}', '{s[1]}', '{_q(s[2])}')" for k, s in enumerate(samples))
    return (f"v(k, language, file, sample) AS (VALUES {rows}), f AS (SELECT {REPO_SQL}' || file AS path, language, k, p_size % 4 AS head, "
            "repeat('note ' || p_name || chr(10), (p_size % 4)::BIGINT) || replace(sample, '{w}', replace(p_name, ' ', '_')) AS text FROM part JOIN v ON k = p_partkey % " + f"{len(samples)})")


@query("rules_fired", f"""
WITH {_dealt_sql(CODE)}, e(k, rule, row_at) AS (VALUES {', '.join(f"({k}, '{s[3][0]}', {s[3][1]})" for k, s in enumerate(CODE) if len(s) > 3)})
SELECT repo, path AS file, 'CC-' || upper(rule) AS identifier, (CASE WHEN row_at = 0 THEN 1 ELSE head + row_at END)::INT AS line FROM f JOIN e USING (k)""")
def rules_fired(spark, d):
    """All 46 rules, each on files where it fires and on files where it does not."""
    return SE.scan_rules(dealt(spark, d, CODE), KEYS).select("repo", "file", "identifier", "line")


SIGNS = [("Python", "a.py", f"a = 1\nb = {sample_of(s[4])} ;{{w}}") for s in R.SIGNATURES] + [("Python", "a.py", f"# {sample_of(s[4])} ;{{w}}") for s in R.SIGNATURES[::9]]


def _signs_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT repo, path, text, '{s[0]}' AS id, string_split_regex(text, '(?i){_q(s[4])}')[1] AS lead FROM f WHERE regexp_matches(text, '(?i){_q(s[4])}')" for s in R.SIGNATURES)
    return f"""
WITH {_dealt_sql(SIGNS)}, h AS ({arms})
SELECT repo, path AS file, id, (1 + length(lead) - length(replace(lead, chr(10), '')))::INT AS line,
  CASE WHEN starts_with(string_split(text, chr(10))[1 + length(lead) - length(replace(lead, chr(10), ''))], '#') THEN 'mentioned in prose' ELSE '' END AS note FROM h"""


@query("signatures_fired", _signs_sql())
def signatures_fired(spark, d):
    """All 89 signatures, each on files that use a system and on files that do not, some in comments."""
    return S.signature_hits(dealt(spark, d, SIGNS), KEYS).select("repo", "file", "id", "line", "note")


MARKS = [(r[0][0], "a.x", f"use {sample_of(r[2])} ;{{w}}") for r in L.FRAMEWORKS]


def _marks_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT repo, path, '{_q(r[1])}' AS framework FROM f WHERE language IN ({', '.join(chr(39) + x + chr(39) for x in r[0])}) AND regexp_matches(text, '{_q(r[2])}')" for r in L.FRAMEWORKS)
    return f"WITH {_dealt_sql(MARKS)} SELECT * FROM ({arms})"


@query("frameworks_fired", _marks_sql())
def frameworks_fired(spark, d):
    """All framework markers, each on files of its language that hold it."""
    return SY.frameworks(dealt(spark, d, MARKS), KEYS).select("repo", "path", F.explode("frameworks").alias("framework"))


@query("entries_fired", f"WITH {_dealt_sql(ENTRIES)} SELECT repo, path FROM f WHERE (head = 0 OR language <> 'Shell') AND k IN ({', '.join(str(k) for k, s in enumerate(ENTRIES) if s[3])})")
def entries_fired(spark, d):
    """The seven rules for program entries, and texts that only look like one."""
    return SY.entry_files(dealt(spark, d, ENTRIES), KEYS)


IMAGE_NAMES = [sample_of(r[0]) for r in R.IMAGES] + ["acme/shop", "busybox", "python"]
COMPOSE = [("", "compose.yaml", f"services:\n    main{k}:\n        image: 'hub/{name}:1'  # {{w}}\n    side:\n        build: .\n        image: hub/{{w}}\n") for k, name in enumerate(IMAGE_NAMES)]


def _images_sql() -> str:
    case = " ".join(f"WHEN regexp_matches(image, '(?i){_q(r[0])}') THEN '{_q(r[1])}'" for r in R.IMAGES)
    names = ", ".join(f"({k}, '{n}')" for k, n in enumerate(IMAGE_NAMES))
    return f"""
WITH n(k, image) AS (VALUES {names}), u AS (SELECT {REPO_SQL}compose.yaml' AS file, unnest(['main' || k, 'side']) AS service, unnest(['hub/' || image || ':1', 'hub/' || replace(p_name, ' ', '_')]) AS image FROM part JOIN n ON k = p_partkey % {len(IMAGE_NAMES)})
SELECT * FROM (SELECT repo, file, service, CASE {case} END AS name FROM u) WHERE name IS NOT NULL"""


@query("image_rules", _images_sql())
def image_rules(spark, d):
    """All rules on images, over services of compose files without a first document line."""
    p = spread(table(spark, d, "part"))
    k = (F.col("p_partkey") % len(COMPOSE)).cast("int")
    f = p.select(F.col("p_brand").alias("repo"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/compose.yaml")).alias("path"), F.lit("infra").alias("kind"),
                 F.replace(_pick([s[2] for s in COMPOSE], k), F.lit("{w}"), _word()).alias("text"))
    none = f.limit(0)
    return I.image_uses(I.containers(f, KEYS), I.kubernetes(none, KEYS), I.terraform(none, KEYS), KEYS).select("repo", "file", "service", "name")


# Heads over several lines, of one to several arguments, with comments and brackets in strings; and calls, which are none.
HEADS = (
    ("Python", "a.py", "@router.post(  # note (\n    '/v1/{w}',\n    tags=['a)'],\n)\nasync def make_{w}(\n    self, a: int,  # first\n    *args,\n):\n    call(\n        1)\n"),
    ("Python", "a.py", "class C_{w}(\n    Base,\n):\n    @app.route(\n        '/x/{w}', methods=[\n            'PUT', 'GET'])\n    def run(self,\n            b=1):\n        pass\n"),
    ("Python", "a.py", "@task\ndef one_{w}(): pass\nx = [\n    call(\n        2)]\n"),
)
_P = "p AS (SELECT *, p_size % 4 AS head, replace(p_name, ' ', '_') AS w, p_partkey % 3 AS k FROM part)"


@query("python_heads", rf"""
WITH {_P}
SELECT {REPO_SQL}a.py' AS file, 'make_' || w AS name, 'function' AS kind, (head + 5)::INT AS line, 'def make_' || w || '(self, a, args)' AS signature FROM p WHERE k = 0
UNION ALL SELECT {REPO_SQL}a.py', unnest(['C_' || w, 'C_' || w || '.run']), unnest(['class', 'method']), (head + unnest([1, 7]))::INT, unnest(['class C_' || w || '( Base, )', 'def run(self, b)']) FROM p WHERE k = 1
UNION ALL SELECT {REPO_SQL}a.py', 'one_' || w, 'function', (head + 2)::INT, 'def one_' || w || '()' FROM p WHERE k = 2""")
def python_heads(spark, d):
    """Classes and functions whose heads run over several lines."""
    return SY.symbols(dealt(spark, d, HEADS), KEYS).select("repo", "file", "name", "kind", "line", "signature")


@query("python_routes", rf"""
WITH {_P}
SELECT {REPO_SQL}a.py' AS file, 'http' AS kind, 'POST' AS method, '/v1/' || w AS path, 'make_' || w AS handler, (head + 5)::INT AS line FROM p WHERE k = 0
UNION ALL SELECT {REPO_SQL}a.py', 'http', unnest(['PUT', 'GET']), '/x/' || w, 'C_' || w || '.run', (head + 7)::INT FROM p WHERE k = 1
UNION ALL SELECT {REPO_SQL}a.py', 'event', 'TASK', 'one_' || w, 'one_' || w, (head + 2)::INT FROM p WHERE k = 2""")
def python_routes(spark, d):
    """Routes and tasks whose decorators run over several lines."""
    return SY.endpoints(dealt(spark, d, HEADS), KEYS).select("repo", "file", "kind", "method", "path", "handler", "line")


# What every part asks for: (language, asking file, module, relative), and which files it brings: (language, path, parts that bring it: every so many).
ASKED = (
    ("Go", "svc/main.go", "github.com/acme/svc/p{k}", False), ("Go", "svc/main.go", "github.com/o{k}/b/c", False), ("Go", "svc/main.go", "net{k}", False),
    ("Java", "j/src/main/java/com/acme/p{k}/Repo.java", "com.acme.p{k}.Repo", False), ("Java", "j/src/main/java/com/acme/p{k}/Repo.java", "java.util.L{k}", False),
    ("Java", "j/src/main/java/com/acme/p{k}/Repo.java", "org.x.y{k}.Z", False),
    ("C#", "n/Use.cs", "Acme.Orders{k}", False), ("C#", "n/Use.cs", "System.T{k}", False),
    ("Rust", "rs{k}/src/main.rs", "c_{k}", False), ("Rust", "rs{k}/src/main.rs", "util", True), ("Rust", "rs{k}/src/main.rs", "std", False), ("Rust", "rs{k}/src/main.rs", "crate", False),
)
BROUGHT = (("Go", "svc/p{k}/x.go", 2), ("Java", "j/src/main/java/com/acme/p{k}/Repo.java", 1), ("C#", "n/Orders{k}.cs", 3), ("Rust", "crates/c-{k}/src/lib.rs", 2), ("Rust", "rs{k}/src/util.rs", 3))


@query("resolve_languages", f"""
WITH a(language, file, module) AS (VALUES {', '.join(f"('{x[0]}', '{x[1]}', '{x[2]}')" for x in ASKED)}),
q AS (SELECT p_brand AS repo, p_partkey AS k, language, module AS shape, replace(file, '{{k}}', p_partkey::VARCHAR) AS file, replace(module, '{{k}}', p_partkey::VARCHAR) AS module FROM part, a),
r AS (SELECT *, CASE
  WHEN shape LIKE '%svc/p%' AND k % 2 = 0 THEN 'svc/p' || k || '/x.go' WHEN shape LIKE 'com.%' THEN file WHEN shape LIKE 'Acme%' AND k % 3 = 0 THEN 'n/Orders' || k || '.cs'
  WHEN shape LIKE 'c!_%' ESCAPE '!' AND k % 2 = 0 THEN 'crates/c-' || k || '/src/lib.rs' WHEN shape = 'util' AND k % 3 = 0 THEN 'rs' || k || '/src/util.rs' ELSE '' END AS internal_file,
  shape IN ('std') OR shape LIKE 'net%' OR shape LIKE 'java.%' OR shape LIKE 'System%' AS stdlib FROM q),
s AS (SELECT *, CASE WHEN internal_file <> '' OR stdlib OR shape = 'crate' OR shape LIKE '%svc/p%' THEN '' WHEN language = 'Go' THEN 'github.com/o' || k || '/b' WHEN language = 'Java' THEN 'org.x.y' || k ELSE module END AS external_package FROM r)
SELECT repo, file, module, internal_file, external_package, stdlib, internal_file = '' AND external_package = '' AND NOT stdlib AS unresolved FROM s""")
def resolve_languages(spark, d):
    """Go modules, JVM packages, .NET namespaces and Rust crates: to a file of the repository, a package, the standard library or nothing."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("k"))
    text = lambda shape: F.replace(F.lit(shape), F.lit("{k}"), F.col("k").cast("string"))
    brought = F.array(*[F.struct(F.lit(x[0]).alias("language"), text(x[1]).alias("path"), (F.col("k") % x[2] == 0).alias("there")) for x in BROUGHT])
    f = p.select("repo", F.explode(brought).alias("x")).where("x.there").select("repo", "x.path", "x.language")
    asked = F.array(*[F.struct(F.lit(x[0]).alias("language"), text(x[1]).alias("file"), text(x[2]).alias("module"), F.lit(x[3]).alias("relative")) for x in ASKED])
    i = p.select("repo", F.explode(asked).alias("x")).select("repo", "x.*", F.lit(1).alias("line"), F.lit("").alias("raw"))
    mods = p.select("repo").distinct().select("repo", F.lit("svc/go.mod").alias("path"), F.lit("svc").alias("dir"), F.lit("go").alias("ecosystem"), F.lit("").alias("name"), F.lit("github.com/acme/svc").alias("module_path"))
    alias = spark.createDataFrame([], "repo string, path string, ord int, prefix string, target string")
    return RS.resolve(i, f, mods, alias, KEYS).select("repo", "file", "module", "internal_file", "external_package", "stdlib", "unresolved")
