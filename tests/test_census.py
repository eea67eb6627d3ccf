"""A small shop of four applications, end to end."""

import json

import pytest
from pyspark.sql import functions as F

FILES = {
    "README.md": "# Shop\n\nOrders and parcels of a small shop.\n",
    "docker-compose.yml": "services:\n  api:\n    build: ./apps/api\n    depends_on:\n      - db\n      - bus\n  web:\n    build: ./apps/web\n    depends_on:\n      - api\n  worker:\n    build: ./apps/worker\n    depends_on: [bus]\n  db:\n    image: postgres:16\n  bus:\n    image: bitnami/kafka:3\n",
    "apps/api/pyproject.toml": '[project]\nname = "shop-api"\ndependencies = ["fastapi>=0.1", "sqlalchemy"]\n',
    "apps/api/Dockerfile": "FROM python:3.12\nCOPY . .\nCMD [\"uvicorn\"]\n",
    "apps/api/app/main.py": "from fastapi import FastAPI\n\nfrom .routers.orders import router\n\napp = FastAPI()\nDEBUG = True\n",
    "apps/api/app/routers/orders.py": 'from fastapi import APIRouter, HTTPException\n\nfrom shop_shared.models import Order\n\nfrom ..services.order_service import OrderService\n\nrouter = APIRouter()\n\n\n@router.get("/orders/{order_id}")\ndef get_order(order_id: str):\n    if order_id is None:\n        raise HTTPException(status_code=404)\n\n\n@router.post("/orders")\ndef create_order(payload: dict):\n    return 1\n',
    "apps/api/app/services/order_service.py": "import stripe\nfrom ..repositories.order_repository import OrderRepository\nfrom shop_shared.models import Order\n\n\nclass OrderService:\n    def pay(self):\n        stripe.Charge.create(amount=1)\n",
    "apps/api/app/repositories/order_repository.py": 'import os\n\nimport sqlalchemy\n\nURL = os.getenv("DATABASE_URL", "postgres://shop:pa55word@db/orders")\n\n\nclass OrderRepository:\n    def find(self, cur, name):\n        cur.execute("SELECT id FROM orders WHERE name = \'%s\'" % name)\n',
    "apps/api/app/config.py": 'payment_secret = "q8Zt2LmX0vB7"\n',
    "apps/web/package.json": '{"name":"shop-web","private":true,"dependencies":{"react":"^18.2.0","lodash":"*"},"devDependencies":{"vite":"^5"}}',
    "apps/web/tsconfig.json": '{"compilerOptions":{"baseUrl":".","paths":{"@/*":["src/*"]}}}',
    "apps/web/src/main.tsx": "import React from 'react';\nimport { Orders } from '@/components/Orders';\nimport { load } from './api/client';\n",
    "apps/web/src/components/Orders.tsx": "import React from 'react';\nimport { load } from '../api/client';\nexport function Orders() { return null; }\n",
    "apps/web/src/api/client.ts": "export const load = () => fetch('https://parcels.shipco.io/v2/list');\n",
    "apps/worker/pyproject.toml": '[project]\nname = "shop-worker"\ndependencies = ["celery"]\n',
    "apps/worker/worker/tasks.py": "import hashlib\nfrom celery import Celery\nimport kafka\nfrom shop_shared.models import Order\nfrom .store import keep\n\napp = Celery('w')\n\n\n@app.task(name='ship')\ndef ship_order(order_id):\n    return hashlib.md5(order_id).hexdigest()\n",
    "apps/worker/worker/store.py": "import boto3\ns3 = boto3.client('s3')\n\n\ndef keep(x):\n    return x\n",
    "packages/shared/pyproject.toml": '[project]\nname = "shop-shared"\n',
    "packages/shared/shop_shared/__init__.py": "",
    "packages/shared/shop_shared/models.py": "from . import events\n\n\nclass Order:\n    pass\n",
    "packages/shared/shop_shared/events.py": "CREATED = 'order.created'\n",
    "infra/main.tf": 'resource "aws_s3_bucket" "b" {\n  acl = "public-read"\n}\n',
    ".github/workflows/ci.yml": "name: CI\non: [push]\njobs:\n  test:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4\n      - run: pytest\n",
    "db/schema.sql": "CREATE TABLE orders (id int);\n",
    "tests/test_orders.py": "def test_x():\n    assert True\n",
    "node_modules/x/index.js": "eval(1)\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    from codecensus.plans.census import census

    rows = [("shop", p, len(t), t) for p, t in FILES.items()]
    rows += [("notes", p, 10, "words\n") for p in ("README.md", "a.md", "b.md", "c/d.md")]
    raw = spark.createDataFrame(rows, "repo string, path string, size long, text string")
    return census(raw)


def test_apps_and_files(tables):
    shop = tables["apps"].where("repo = 'shop'").collect()
    assert {(a.name, a.kind) for a in shop} == {("shop-api", "service"), ("shop-web", "frontend"), ("shop-worker", "job"), ("shop-shared", "library")}
    assert tables["files"].where("path like 'node_modules%'").count() == 0
    assert tables["walk_stats"].where("repo = 'shop'").first().vendored == 1
    api = [a for a in shop if a.name == "shop-api"][0]
    assert api.purpose.startswith("kind: service; language: Python; frameworks: FastAPI") and "order" in api.purpose
    shared = [a for a in shop if a.name == "shop-shared"][0]
    assert "used by: shop-api, shop-worker" in shared.purpose


def test_edges(tables):
    names = {a.id: a.name for a in tables["apps"].collect()}
    dep = {(names[e.source], names[e.target]) for e in tables["app_edges"].collect()}
    assert {("shop-api", "shop-shared"), ("shop-worker", "shop-shared")} <= dep
    deploy = {(names[e.source], names[e.target]) for e in tables["edges"].where("kind = 'deploy'").collect()}
    assert deploy == {("shop-web", "shop-api")}
    files = {(e.source.split("/")[-1], e.target.split("/")[-1]) for e in tables["file_edges"].collect()}
    assert {("main.py", "orders.py"), ("orders.py", "order_service.py"), ("main.tsx", "Orders.tsx"), ("tasks.py", "store.py")} <= files


def test_endpoints_and_systems(tables):
    ep = {(e.method, e.path) for e in tables["endpoints"].collect()}
    assert {("GET", "/orders/{order_id}"), ("POST", "/orders"), ("TASK", "ship_order")} <= ep
    sysn = {s.name: set(s.apps) for s in tables["systems"].collect()}
    assert {"PostgreSQL", "Apache Kafka", "Stripe", "AWS S3", "parcels.shipco.io"} <= set(sysn)
    assert "app-apps-api" in sysn["PostgreSQL"] and {"app-apps-api", "app-apps-worker"} <= sysn["Apache Kafka"]
    env = {e.name: e.kind for e in tables["env_vars"].collect()}
    assert env == {"DATABASE_URL": "database"}


def test_findings(tables):
    got = {f.identifier for f in tables["findings"].collect()}
    for i in ("CC-SECRET-PASSWORD-ASSIGN", "CC-SECRET-CONN-STRING", "CC-PY-SQL-FORMAT", "CC-WEAK-HASH", "CC-DEBUG-ON", "CC-TF-PUBLIC-BUCKET", "CC-DOCKER-ROOT", "CC-DEP-NOLOCK", "CC-DEP-UNPINNED", "CC-DEP-MISSING"):
        assert i in got, i
    missing = {f.package for f in tables["findings"].where("identifier = 'CC-DEP-MISSING'").collect()}
    assert {"kafka", "boto3", "stripe"} <= missing
    assert tables["findings"].where("file <> '' and (title = '' or identifier = '')").count() == 0
    deps = {d.name: d for d in tables["dependencies"].collect()}
    assert deps["fastapi"].used and deps["lodash"].version == "*" and not deps["lodash"].used


def test_flows(tables):
    nodes = tables["flow_nodes"].collect()
    kinds = {n.kind for n in nodes}
    assert {"start", "end", "task", "decision"} <= kinds
    flow = [n for n in nodes if n.id == "entry" and n.file.endswith("orders.py")][0].flow
    mine = sorted((n.ord, n.id, n.label, n.lane) for n in nodes if n.flow == flow)
    labels = [m[2] for m in mine]
    # Everything below api/ is one lane with the entry; the shared package lies outside the app.
    assert "Models" in labels and "Client sends request" in labels
    edges = {(e.source, e.target) for e in tables["flow_edges"].where(F.col("flow") == flow).collect()}
    ids = {m[1] for m in mine}
    assert all(s in ids and t in ids for s, t in edges) and ("start", "entry") in edges
    assert tables["messages"].count() == tables["flow_edges"].count()
    assert tables["overview_nodes"].where("id = 'process'").count() >= 3


def test_models_and_profile(tables):
    levels = {r.level for r in tables["c4_elements"].where("repo = 'shop'").collect()}
    assert {"system", "person", "container", "component", "database", "system_ext"} <= levels
    ids = {r.id for r in tables["archimate_elements"].collect()}
    assert all(r.source in ids and r.target in ids for r in tables["archimate_relations"].collect())
    prof = {r.repo: r.profile for r in tables["facts"].collect()}
    assert prof == {"shop": "monorepo", "notes": "documentation"}
    s = {r.repo: r for r in tables["summary"].collect()}
    assert s["shop"].shape == "monorepo" and s["shop"].has_ci and s["shop"].has_containers and s["shop"].risk_level in ("critical", "high")
    skipped = {(r.repo, r.artifact) for r in tables["decisions"].where("NOT include").collect()}
    assert ("notes", "c4-context") in skipped and ("shop", "c4-context") not in skipped
    assert tables["decisions"].groupBy("repo").count().where("count = 22").count() == 2
    sections = {r.section for r in tables["overview"].where("repo = 'shop'").collect()}
    assert {"users", "operations", "health", "capabilities", "data", "dependencies", "risks"} <= sections
    ranks = tables["ranks"].groupBy("repo").agg(F.sum("rank").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-3 for r in ranks)
    layer = {r.node: r.layer for r in tables["layers"].collect()}
    assert all(layer[e.source] > layer[e.target] for e in tables["component_edges"].collect() if e.source in layer)
    q = tables["questions"].where("repo = 'shop'").orderBy("ord").collect()
    assert q and len(q) <= 40 and [x.priority for x in q] == sorted(x.priority for x in q)


def test_sinks(spark, tables, tmp_path):
    from codecensus.sinks import exports as X
    from codecensus.sources import tables as T

    csv = X.csv_tables(tables, ["repo"])
    X.write_csv({"dependencies": csv["dependencies"]}, str(tmp_path / "csv"), ["repo"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv" / "dependencies"))
    assert back.count() == tables["dependencies"].count()
    sheets = X.workbook(tables, ["repo"])
    assert len(sheets) == 11 and sheets["Infrastructure"].count() >= 7 and sheets["Dependency graph"].where("source_name = 'shop-api'").count() > 0
    repos = tables["metrics"].select("repo")
    for make in (lambda: X.cyclonedx(tables["dependencies"], tables["findings"], repos, ["repo"], "2024-01-01"), lambda: X.spdx(tables["dependencies"], repos, ["repo"], "2024-01-01")):
        lines = make().where("repo = 'shop'").orderBy("section", "ord").collect()
        doc = json.loads("".join(r.line for r in lines))
        assert doc.get("specVersion") == "1.5" or doc.get("spdxVersion") == "SPDX-2.3"
    lines = X.model_lines({"apps": tables["apps"], "findings": tables["findings"]}, ["repo"])
    apps = T.model_section(lines, "apps")
    assert {r.name for r in apps.collect()} == {r.name for r in tables["apps"].collect()}
    head = X.headline(tables["metrics"], tables["summary"], tables["facts"], ["repo"]).where("repo = 'shop'").first()
    assert json.loads(head.manifest)["summary"]["applications"] == 4
    nodes, links = X.graph_payload(tables["components"], tables["systems"], tables["edges"], ["repo"])
    ids = {r.id for r in nodes.collect()}
    assert all(r.source in ids and r.target in ids for r in links.collect()) and links.count() > 0


def test_rerun_is_identical(spark):
    from codecensus.operators.security import scan_rules
    from codecensus.functions.classify import file_kind, language

    rows = [("shop", p, t) for p, t in FILES.items()]
    f = spark.createDataFrame(rows, "repo string, path string, text string").withColumn("language", language("path")).withColumn("kind", file_kind("path", "language"))
    once = sorted(map(str, scan_rules(f, ["repo"]).collect()))
    again = sorted(map(str, scan_rules(f.repartition(3), ["repo"]).collect()))
    assert once == again


def test_flow_steps_by_lane(spark):
    from codecensus.operators.flows import build_flows

    def df(schema, *rows):
        return spark.createDataFrame([("r", *row) for row in rows], "repo string, " + schema)

    files = ["x/routes.py", "x/services/a.py", "x/services/b.py", "x/services/c.py", "x/domain/d.py", "x/repositories/e.py"]
    ep = df("app string, kind string, method string, path string, handler string, file string, line int", ("a", "http", "GET", "/api/items", "h", files[0], 3))
    edges = df("source string, target string", *[(files[0], f) for f in files[1:]])
    own = df("path string, app string", *[(f, "a") for f in files])
    sysf = df("file string, id string", (files[5], "ext-postgres"))
    systems = df("id string, name string, kind string", ("ext-postgres", "PostgreSQL", "database"))
    texts = df("path string, text string", (files[0], "if not cached: raise NotFound"))
    apps = df("id string, name string", ("a", "A"))
    flows, nodes, fe = build_flows(ep, edges, own, sysf, systems, texts, apps, ["repo"])
    got = [(n.id, n.label, n.kind, n.lane) for n in nodes.orderBy("ord").collect()]
    assert got == [
        ("start", "Client sends request", "start", "Client"), ("entry", "GET /api/items", "task", "Interface"), ("d0", "Cache hit?", "decision", "Interface"),
        ("d0-no", "Serve cached result", "end", "Interface"), ("d1", "Record found?", "decision", "Interface"), ("d1-no", "Return 404", "end", "Interface"),
        ("s1", "A", "subprocess", "Application"), ("s2", "B", "subprocess", "Application"), ("s3", "D", "subprocess", "Domain"), ("s4", "E", "task", "Data"),
        ("sys-ext-postgres", "PostgreSQL", "datastore", "Data"), ("end", "Response returned", "end", "Client")]
    e = {(x.source, x.target, x.label, x.kind) for x in fe.collect()}
    assert e == {
        ("start", "entry", "", "sequence"), ("entry", "d0", "", "sequence"), ("d0", "d0-no", "no", "conditional"), ("d0", "d1", "yes", "conditional"), ("d1", "d1-no", "no", "conditional"),
        ("d1", "s1", "yes", "conditional"), ("s1", "s2", "", "sequence"), ("s2", "s3", "", "sequence"), ("s3", "s4", "", "sequence"), ("s4", "sys-ext-postgres", "read/write", "data"), ("s4", "end", "", "sequence")}
    assert flows.first().name == "Items request flow"
