from codecensus.operators import deps as D
from codecensus.operators import infra as I

COMPOSE = '''version: "3.9"
services:
    api:
        build: ./apps/api
        ports:
            - "8080:8080"
        environment:
            - DB_URL=postgres://x
            - KEY=1
        depends_on: [db, web]
    web:
        build:
            context: ./apps/web
        depends_on:
            db:
                condition: ok
    db:
        image: postgres:15
        environment:
            POSTGRES_PASSWORD: app
        volumes:
            - data:/x
'''


def files(spark, *rows):
    from codecensus.functions.classify import file_kind, language

    df = spark.createDataFrame([("r", *row) for row in rows], "repo string, path string, text string")
    return df.withColumn("language", language("path")).withColumn("kind", file_kind("path", "language"))


def test_infra(spark):
    f = files(
        spark, ("docker-compose.yml", COMPOSE),
        ("api/Dockerfile", "FROM golang:1.22 AS build\nENV A=1\nFROM alpine\nEXPOSE 80\nEXPOSE 81\nUSER app\nCMD [\"x\"]\nENTRYPOINT [\"y\"]\n"),
        ("k8s/all.yaml", "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: web\n  namespace: prod\nspec:\n  replicas: 3\n  template:\n    spec:\n      containers:\n        - image: redis:7\n          ports:\n            - containerPort: 80\n---\napiVersion: v1\nkind: Service\nmetadata:\n  name: svc\nspec:\n  ports:\n    - port: 443\n"),
        ("infra/main.tf", 'provider "aws" {}\n\nresource "aws_elasticsearch_domain" "es" {\n}\nmodule "vpc" {\n}\n'),
        (".github/workflows/ci.yml", "name: CI\non:\n  push:\n  pull_request:\njobs:\n  build:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4\n      - run: make test\n  deploy:\n    needs: [build]\n    runs-on: self\n    steps:\n      - run: |\n          ./go.sh\n"),
        (".gitlab-ci.yml", "stages:\n  - a\nunit:\n  stage: test\n  script:\n    - x\nvariables:\n  script: 1\n"),
        ("deploy/Jenkinsfile", "stage('Build') { }\nstage(\"Ship\") {}\n"),
        ("serverless.yml", "service: pay\nprovider:\n  name: aws\n  runtime: python3.12\nfunctions:\n  charge:\n    handler: a.b\n    events:\n      - http: x\n      - sqs: y\n"),
        ("chart/Chart.yaml", "name: mychart\nversion: 0.1.0\ndescription: d\n"))
    c = I.containers(f, ["repo"])
    got = {r.name: r for r in c.collect()}
    assert set(got) == {"api", "web", "db"}
    assert (got["api"].build, got["api"].ports, got["api"].env_keys, got["api"].depends_on) == ("./apps/api", ["8080:8080"], ["DB_URL", "KEY"], ["db", "web"])
    assert (got["web"].build, got["web"].depends_on) == ("./apps/web", ["db"])
    assert (got["db"].image, got["db"].env_keys, got["db"].volumes) == ("postgres:15", ["POSTGRES_PASSWORD"], ["data:/x"])
    d = I.dockerfiles(f, ["repo"]).first()
    assert (d.base_images, d.stages, d.ports, d.user, d.entrypoint, d.env, d.multistage) == (["golang:1.22", "alpine"], ["build"], [80, 81], "app", '["y"]', {"A": "1"}, True)
    k = {r.name: r for r in I.kubernetes(f, ["repo"]).collect()}
    assert (k["web"].kind, k["web"].namespace, k["web"].images, k["web"].ports, k["web"].replicas) == ("Deployment", "prod", ["redis:7"], ["80"], 3)
    assert (k["svc"].ports, k["svc"].replicas) == (["443"], None)
    t = {(r.block, r.type, r.name, r.provider, r.line) for r in I.terraform(f, ["repo"]).collect()}
    assert t == {("provider", "aws", "", "aws", 1), ("resource", "aws_elasticsearch_domain", "es", "aws", 3), ("module", "vpc", "", "vpc", 5)}
    p = {r.system: r for r in I.pipelines(f, ["repo"]).collect()}
    ci = p["GitHub Actions"]
    assert (ci.name, ci.triggers, [j.name for j in ci.jobs], ci.jobs[0].uses, ci.jobs[0].commands, ci.jobs[1].needs, ci.jobs[1].commands) == (
        "CI", ["push", "pull_request"], ["build", "deploy"], ["actions/checkout@v4"], ["make test"], ["build"], ["./go.sh"])
    assert [(j.name, j.stage) for j in p[".gitlab-ci.yml"].jobs] == [("unit", "test")]
    assert [j.name for j in p["Jenkins"].jobs] == ["Build", "Ship"]
    s = I.serverless(f, ["repo"]).first()
    assert (s.service, s.provider, s.runtime, s.functions[0].name, s.functions[0].handler, s.functions[0].events) == ("pay", "aws", "python3.12", "charge", "a.b", ["http", "sqs"])
    assert I.helm(f, ["repo"]).first().name == "mychart"
    sysd = {r.name: r for r in I.image_systems(I.image_uses(c, I.kubernetes(f, ["repo"]), I.terraform(f, ["repo"]), ["repo"]), ["repo"]).collect()}
    assert set(sysd) == {"PostgreSQL", "Redis", "Elasticsearch / OpenSearch"} and sysd["PostgreSQL"].evidence[0].note == "service db: postgres:15"
    apps = spark.createDataFrame([("r", "app-api", "apps/api"), ("r", "app-web", "apps/web")], "repo string, id string, root string")
    e = {(r.source, r.target, r.kind) for r in I.container_edges(c, apps, ["repo"]).collect()}
    assert e == {("app-api", "app-web", "deploy")}
    systems = I.image_systems(I.image_uses(c, I.kubernetes(f, ["repo"]), I.terraform(f, ["repo"]), ["repo"]), ["repo"])
    uses = I.image_uses(c, I.kubernetes(f, ["repo"]), I.terraform(f, ["repo"]), ["repo"])
    a = {(r.id, r.app) for r in I.compose_systems(c, uses, systems, apps, ["repo"]).collect()}
    assert a == {("ext-postgresql", "app-api"), ("ext-postgresql", "app-web")}


DECL = "repo string, declared_in string, ord int, name string, version string, ecosystem string, scope string, direct boolean, purl string"


def test_reconcile(spark):
    declared = spark.createDataFrame([
        ("r", "a/pyproject.toml", 0, "My_Pkg", ">=1", "pypi", "dev", True, "pkg:pypi/My_Pkg@1"), ("r", "b/pyproject.toml", 0, "my-pkg", "", "pypi", "runtime", True, ""),
        ("r", "a/pyproject.toml", 1, "pyyaml", "6.0", "pypi", "runtime", True, ""), ("r", "a/pyproject.toml", 2, "unused", "1", "pypi", "runtime", True, ""),
        ("r", "n/package.json", 0, "request", "*", "npm", "runtime", True, ""), ("r", "n/package.json", 1, "tslint", "", "npm", "dev", True, "")], DECL)
    locked = spark.createDataFrame([
        ("r", "poetry.lock", 0, "my-pkg", "1.5", "pypi", "runtime", False, "pkg:pypi/my-pkg@1.5"), ("r", "poetry.lock", 1, "deep", "9", "pypi", "runtime", False, ""),
        ("r", "poetry.lock", 2, "pyyaml", "7", "pypi", "runtime", False, "")], DECL)
    usage = spark.createDataFrame([
        ("r", "my-pkg", "pypi", 1, ["a.py"], ["app"]), ("r", "yaml", "pypi", 1, ["b.py"], []), ("r", "ghost", "pypi", 2, ["c.py", "d.py"], []), ("r", "maybe", "pypi", 1, ["c.py"], [])],
        "repo string, name string, ecosystem string, n_files long, files array<string>, apps array<string>")
    optional = spark.createDataFrame([("r", "maybe")], "repo string, name string")
    deps = D.reconcile(declared, locked, ["repo"])
    m = D.match_usage(deps, usage, ["repo"])
    full = D.with_usage(deps, usage, m, ["repo"]).persist()
    got = {r.key: (r.version, r.scope, r.direct, r.used, r.purl) for r in full.collect()}
    assert got["my-pkg"] == ("1.5", "runtime", True, True, "pkg:pypi/my-pkg@1.5")
    assert got["pyyaml"][:4] == ("6.0", "runtime", True, True) and got["deep"][:4] == ("9", "runtime", False, False)
    miss = D.undeclared(usage, m, optional, ["repo"])
    assert [r.name for r in miss.collect()] == ["ghost"]
    locks = spark.createDataFrame([("r", "poetry.lock")], "repo string, path string")
    f = {(r.identifier, r.package, r.file) for r in D.hygiene_findings(full, locks, ["repo"]).unionByName(D.usage_findings(full, miss, ["repo"])).collect()}
    assert f == {("CC-DEP-NOLOCK", "", "n/package.json"), ("CC-DEP-UNPINNED", "request", "n/package.json"), ("CC-DEP-DEPRECATED", "request", "n/package.json"),
                 ("CC-DEP-UNUSED", "unused", "a/pyproject.toml"), ("CC-DEP-UNUSED", "request", "n/package.json"), ("CC-DEP-MISSING", "ghost", "c.py")}


def test_two_missing_lockfiles_stay_apart(spark):
    from codecensus.operators.security import dedupe_findings

    declared = spark.createDataFrame([
        ("r", "p/pyproject.toml", 0, "a", "1", "pypi", "runtime", True, ""), ("r", "w/package.json", 0, "b", "1", "npm", "runtime", True, "")], DECL)
    none = spark.createDataFrame([], DECL)
    deps = D.reconcile(declared, none, ["repo"])
    out = D.hygiene_findings(deps, spark.createDataFrame([], "repo string, path string"), ["repo"])
    got = dedupe_findings(out, ["repo"], ["id"]).collect()
    assert {(r.identifier, r.file) for r in got} == {("CC-DEP-NOLOCK", "p/pyproject.toml"), ("CC-DEP-NOLOCK", "w/package.json")}


def test_advisories(spark):
    deps = spark.createDataFrame([
        ("r", "lodash", "^4.17.20", "npm", ["package.json"]), ("r", "left", "1.2.3", "npm", ["package.json"]), ("r", "six", "==1.0", "pypi", ["p.toml"]), ("r", "wide", ">=1", "npm", ["x"])],
        "repo string, name string, version string, ecosystem string, declared_in array<string>")
    adv = spark.createDataFrame([
        ("GHSA-1", ["CVE-2021-1"], "npm", "lodash", ["4.17.20"], [(None, "4.17.21")], [("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")], "", "bad", ["CWE-1"], ["u"]),
        ("GHSA-2", [], "npm", "left", [], [("1.0.0", "1.10.0")], [], "moderate", "", [], []), ("GHSA-3", [], "PyPI", "six", ["2.0"], [("1.5", None)], [], "", "", [], [])],
        "id string, aliases array<string>, ecosystem string, package string, versions array<string>, events array<struct<introduced:string,fixed:string>>, severity array<struct<type:string,score:string>>, label string, summary string, cwe_ids array<string>, refs array<string>")
    got = {(r.package, r.identifier, r.severity, r.fixed_version, r.version, r.title) for r in D.advisory_findings(deps, adv, ["repo"]).collect()}
    assert got == {("lodash", "CVE-2021-1", "critical", "4.17.21", "4.17.20", "lodash: bad (CVSS 9.8)"), ("left", "GHSA-2", "medium", "1.10.0", "1.2.3", "left: Known vulnerability")}
