"""Orchestration and pipelines, read from nested YAML derived from parts: shapes differ from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.operators import infra as I
from codecensus.plans.extract_queries import KEYS, REPO_SQL
from codecensus.plans.registry import query, table
from codecensus.session import spread, stored


def _files(spark, d, name: Column | str, *texts: str) -> DataFrame:
    """One file per part; the text is the one of the part's number, with ``{k}``, ``{n}``, ``{w}`` for key, size and words."""
    p = spread(table(spark, d, "part"))
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    for mark, value in (("{k}", F.col("p_partkey").cast("string")), ("{n}", F.col("p_size").cast("string")), ("{w}", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))):
        text = F.replace(text, F.lit(mark), value)
    name = F.lit(name) if isinstance(name, str) else name
    return p.select(F.col("p_brand").alias("repo"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"), F.lit("infra").alias("kind"), text.alias("text"))


P_SQL = "p AS (SELECT *, p_partkey AS k, p_size AS n, replace(p_name, ' ', '-') AS w FROM part)"

K8S = (
    "# several objects\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: \"{w}\"\n  annotations: {image: none, note: 'a, b'}\nspec:\n  replicas: {n}\n  template:\n    spec:\n      containers:\n"
    "      - name: main\n        image: hub/redis:{n} # pinned\n        ports: [{containerPort: 80}, {containerPort: {n}}]\n      - image: 'acme/{w}'\n        command:\n          - |\n            image: not-one\n"
    "---\napiVersion: v1\nkind: Service\nmetadata: {name: svc-{k}, namespace: prod}\nspec:\n  ports:\n    - port: {n}\n",
    "apiVersion: batch/v1\nkind: Job\nmetadata:\n    namespace: ns{n}\n    name: job-{k}\nspec:\n    replicas: many\n    template: {spec: {containers: [{image: pg}, {image: postgres}]}}\n---\nnote: apiVersion without a kind\n",
    "apiVersion: v1\nitems:\n- kind: Pod\n  name: {w}\n",
)


@query("kubernetes", rf"""
WITH {P_SQL}
SELECT {REPO_SQL}all.yaml' AS file, 'Deployment' AS kind, w AS name, '' AS namespace, 'hub/redis:' || n || ' acme/' || w AS images, '80 ' || n AS ports, n::INT AS replicas FROM p WHERE k % 3 = 0
UNION ALL SELECT {REPO_SQL}all.yaml', 'Service', 'svc-' || k, 'prod', '', n::VARCHAR, NULL FROM p WHERE k % 3 = 0
UNION ALL SELECT {REPO_SQL}all.yaml', 'Job', 'job-' || k, 'ns' || n, 'pg postgres', '', NULL FROM p WHERE k % 3 = 1""")
def kubernetes(spark, d):
    """Objects of files with several documents, flow maps and lists, items as deep as their key, block scalars and objects without a kind."""
    out = I.kubernetes(_files(spark, d, "all.yaml", *K8S), KEYS)
    return out.select("repo", "file", "kind", "name", "namespace", F.array_join("images", " ").alias("images"), F.array_join("ports", " ").alias("ports"), "replicas")


ACTIONS = (
    "name: CI {n}\non:\n  push: {branches: [main]}\n  schedule:\n  - cron: '0 {n} * * *'\njobs:\n  build:\n    runs-on: [self-hosted, linux]\n    steps:\n    - uses: actions/checkout@v4\n      with: {run: no}\n"
    "    - name: \"make: it\"\n      run: make {w}\n    - run: |\n        ./go.sh {n}\n        uses: nothing\n  ship-{k}:\n    needs: build\n    runs-on: ubuntu\n    steps: []\n",
    "on: [push, workflow_dispatch]\njobs:\n    only:\n        needs: [a, b-{n}]\n        runs-on: ${{ matrix.os }}\n        steps:\n            -   uses: acme/{w}@v1\n    stray: text\n",
    "on: push\nenv:\n  jobs: none-{k}\n",
)
GITLAB = (
    "stages: [build, test]\nvariables:\n  script: no\nbuild-{n}:\n  stage: build\n  script:\n    - make {w}\n.hidden: &base\n  image: x\nunit:\n  <<: *base\n  script: pytest\n",
    "default:\n  script: no\n\"job: {k}\":\n    stage: s{n}\nplain: text\n",
)
JENKINS = ("pipeline {\n  stages {\n    stage('Build {w}') { }\n    stage(\"Ship {n}\") { }\n  }\n}\n", "node { echo '{k}' }\n")


@query("ci_jobs", rf"""
WITH {P_SQL}, j AS (
SELECT {REPO_SQL}.github/workflows/ci.yml' AS file, 'GitHub Actions' AS system, 'CI ' || n AS name, 'push schedule' AS triggers, unnest(['build', 'ship-' || k]) AS job, '' AS stage,
  unnest(['self-hosted, linux', 'ubuntu']) AS runs_on, unnest(['actions/checkout@v4', '']) AS uses, unnest(['make ' || w || ';./go.sh ' || n, '']) AS commands, unnest(['', 'build']) AS needs FROM p WHERE k % 3 = 0
UNION ALL SELECT {REPO_SQL}.github/workflows/ci.yml', 'GitHub Actions', 'ci.yml', 'push workflow_dispatch', 'only', '', '${{{{ matrix.os }}}}', 'acme/' || w || '@v1', '', 'a b-' || n FROM p WHERE k % 3 = 1
UNION ALL SELECT {REPO_SQL}.github/workflows/ci.yml', 'GitHub Actions', 'ci.yml', 'push', NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE k % 3 = 2
UNION ALL SELECT {REPO_SQL}.gitlab-ci.yml', '.gitlab-ci.yml', '.gitlab-ci.yml', '', unnest(['build-' || n, 'unit']), unnest(['build', '']), '', '', '', '' FROM p WHERE k % 2 = 0
UNION ALL SELECT {REPO_SQL}.gitlab-ci.yml', '.gitlab-ci.yml', '.gitlab-ci.yml', '', 'job: ' || k, 's' || n, '', '', '', '' FROM p WHERE k % 2 = 1
UNION ALL SELECT {REPO_SQL}Jenkinsfile', 'Jenkins', 'Jenkinsfile', '', unnest(['Build ' || w, 'Ship ' || n]), '', '', '', '', '' FROM p WHERE k % 2 = 0
UNION ALL SELECT {REPO_SQL}Jenkinsfile', 'Jenkins', 'Jenkinsfile', '', NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE k % 2 = 1)
SELECT * FROM j""")
def ci_jobs(spark, d):
    """Jobs of three CI formats; a definition without jobs has one row without a job."""
    f = _files(spark, d, ".github/workflows/ci.yml", *ACTIONS).unionByName(_files(spark, d, ".gitlab-ci.yml", *GITLAB)).unionByName(_files(spark, d, "Jenkinsfile", *JENKINS))
    j = I.pipelines(f, KEYS).select("repo", "file", "system", "name", F.array_join("triggers", " ").alias("triggers"), F.explode_outer("jobs").alias("j"))
    return j.select("repo", "file", "system", "name", "triggers", F.col("j.name").alias("job"), "j.stage", "j.runs_on", F.array_join("j.uses", " ").alias("uses"),
                    F.array_join("j.commands", ";").alias("commands"), F.array_join("j.needs", " ").alias("needs"))


SERVERLESS = (
    "service: pay-{w}\nprovider:\n  name: aws\n  runtime: python3.{n}\nfunctions:\n  charge:\n    handler: a.b{k}\n    events:\n      - http: {path: /x, method: get}\n      - sqs\n      - schedule:\n          rate: 1\n  idle: {handler: c.d}\n",
    "service: {w}\nprovider: google\nfunctions: {}\n",
)
CHART = ("apiVersion: v2\nname: {w}\nversion: '0.{n}'\ndescription: >\n  A chart\n  of {k}\nmaintainers:\n  - name: no one\n", "name: \"c{k}\" # chart\nversion: 1.{n}\n")


@query("serverless_charts", rf"""
WITH {P_SQL}
SELECT {REPO_SQL}serverless.yml' AS file, 'pay-' || w AS name, 'aws' AS version, 'python3.' || n AS detail, unnest(['charge', 'idle']) AS part, unnest(['a.b' || k, 'c.d']) AS handler, unnest(['http sqs schedule', '']) AS events FROM p WHERE k % 2 = 0
UNION ALL SELECT {REPO_SQL}serverless.yml', w, '', '', NULL, NULL, NULL FROM p WHERE k % 2 = 1
UNION ALL SELECT {REPO_SQL}Chart.yaml', w, '0.' || n, 'A chart of ' || k, NULL, NULL, NULL FROM p WHERE k % 2 = 0
UNION ALL SELECT {REPO_SQL}Chart.yaml', 'c' || k, '1.' || n, '', NULL, NULL, NULL FROM p WHERE k % 2 = 1""")
def serverless_charts(spark, d):
    """Functions of serverless files, and charts."""
    s = I.serverless(_files(spark, d, "serverless.yml", *SERVERLESS), KEYS).select("repo", "file", F.col("service").alias("name"), F.col("provider").alias("version"), F.col("runtime").alias("detail"), F.explode_outer("functions").alias("f"))
    s = s.select("repo", "file", "name", "version", "detail", F.col("f.name").alias("part"), F.col("f.handler").alias("handler"), F.array_join("f.events", " ").alias("events"))
    none = [F.lit(None).cast("string").alias(c) for c in ("part", "handler", "events")]
    return s.unionByName(I.helm(_files(spark, d, "Chart.yaml", *CHART), KEYS).select("repo", "file", "name", "version", F.col("description").alias("detail"), *none))


COMPOSE = (
    "services:\n  web: &base\n    build: ./apps/web{n}\n    depends_on: [api, db]\n  api:\n    build: {context: apps/api}\n    depends_on:\n      db: {condition: ok}\n  db:\n    image: postgres:{n}\n    ports: [\"5432:5432\"]\n",
    "version: '3'\nservices:\n    web:\n        build:\n            context: ./apps/web{n}/\n        depends_on:\n        - q\n    q:\n        image: rabbitmq\n    lone:\n        image: acme/{w}\nvolumes:\n    db: {}\n",
    "services: {}\nweb:\n  build: ./apps/api\n",
)


@query("compose_links", rf"""
WITH {P_SQL}
SELECT 'r' || k AS repo, 'web' || n AS source, 'api' AS target, 'app' AS what FROM p WHERE k % 3 = 0
UNION ALL SELECT 'r' || k, unnest(['web' || n, 'api']), 'ext-postgresql', 'system' FROM p WHERE k % 3 = 0
UNION ALL SELECT 'r' || k, 'web' || n, 'ext-rabbitmq', 'system' FROM p WHERE k % 3 = 1""")
def compose_links(spark, d):
    """Which app depends on which app or backing system, from the services of compose files and where they are built."""
    f = _files(spark, d, "compose.yml", *COMPOSE).withColumn("repo", F.concat(F.lit("r"), F.regexp_extract("path", r"^m(\d+)", 1)))
    p = table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("repo"), F.array(F.concat(F.lit("web"), F.col("p_size").cast("string")), F.lit("api")).alias("ids"))
    apps = p.select("repo", F.explode("ids").alias("id")).withColumn("root", F.concat(F.lit("apps/"), "id"))
    # Several joins read the services and their images; written once, as in the census.
    c, none = stored(I.containers(f, KEYS)), f.limit(0)
    uses = stored(I.image_uses(c, I.kubernetes(none, KEYS), I.terraform(none, KEYS), KEYS))
    links = I.container_edges(c, apps, KEYS).select("repo", "source", "target", F.lit("app").alias("what"))
    return links.unionByName(I.compose_systems(c, uses, I.image_systems(uses, KEYS), apps, KEYS).select("repo", F.col("app").alias("source"), F.col("id").alias("target"), F.lit("system").alias("what")))
