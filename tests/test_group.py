from codecensus.operators import group as G
from codecensus.operators.manifests import manifests


def files(spark, *rows):
    from codecensus.functions.classify import file_kind, language

    df = spark.createDataFrame([("r", p, t, max(1, t.count("\n"))) for p, t in ((x if isinstance(x, tuple) else (x, "x\n")) for x in rows)], "repo string, path string, text string, loc int")
    return df.withColumn("language", language("path")).withColumn("kind", file_kind("path", "language"))


MONO = [
    ("package.json", '{"name":"root","workspaces":["packages/*"]}'), ("packages/ui/package.json", '{"name":"@acme/ui","main":"i.js"}'),
    "packages/ui/src/a.ts", "packages/ui/src/b.ts", ("apps/api/pyproject.toml", '[project]\nname = "acme-api"\ndependencies = ["fastapi"]\n'),
    "apps/api/app/main.py", "apps/api/app/controllers/c.py", "apps/api/app/services/s.py", "apps/api/app/repositories/r.py", "apps/api/Dockerfile",
    "apps/worker/w.py", "docs/readme.md", "apps/empty/notes.md"]


def test_roots_and_apps(spark):
    f = files(spark, *MONO)
    m = manifests(f, ["repo"])
    roots = G.app_roots(f, m, ["repo"]).persist()
    assert {(r.root, r.manifest) for r in roots.collect()} == {("packages/ui", "packages/ui/package.json"), ("apps/api", "apps/api/pyproject.toml"), ("apps/worker", "")}
    own = G.deepest_prefix(f, roots, ["repo"]).persist()
    at = {r.path: r.root for r in own.collect()}
    assert at["apps/api/app/main.py"] == "apps/api" and at["docs/readme.md"] is None
    marks = spark.createDataFrame([("r", "apps/api/app/main.py", ["FastAPI"])], "repo string, path string, frameworks array<string>")
    ep = spark.createDataFrame([("r", "apps/api/app/main.py")], "repo string, file string")
    readmes = spark.createDataFrame([("r", "apps/api/README.md", "The order API.")], "repo string, path string, summary string")
    apps = {r.name: r for r in G.build_apps(own.where("root is not null"), roots, m, marks, ep, readmes, ["repo"]).collect()}
    api = apps["acme-api"]
    assert (api.id, api.kind, api.languages, api.frameworks, api.description) == ("app-apps-api", "service", ["Python"], ["FastAPI"], "The order API.")
    assert api.architecture_style == "Layered (controller / service / repository)"
    assert apps["@acme/ui"].kind == "library" and apps["Worker"].kind == "job"


def test_no_roots_falls_back_to_repository(spark):
    f = files(spark, "README.md", "notes/a.md")
    assert [(r.root, r.manifest) for r in G.app_roots(f, manifests(f, ["repo"]), ["repo"]).collect()] == [("", "")]


def test_components(spark):
    from pyspark.sql import functions as F

    paths = [f"app/src/{d}/f{i}.py" for d, n in (("orders", 9), ("billing", 8), ("x", 2)) for i in range(n)] + ["app/setup.cfg", "app/tests/test_a.py"]
    f = files(spark, *paths).withColumn("root", F.lit("app")).withColumn("app", F.lit("app-app"))
    apps = spark.createDataFrame([("r", "app-app", "App")], "repo string, id string, name string")
    c = G.components(f, apps, ["repo"]).persist()
    got = {r.path: (r.files, r.kind, r.name, r.languages) for r in c.collect()}
    assert got == {
        "app": (1, "infra", "app", []), "app/tests": (1, "test", "tests", ["Python"]), "app/src/orders": (9, "module", "src/orders", ["Python"]),
        "app/src/billing": (8, "module", "src/billing", ["Python"]), "app/src/x": (2, "module", "src/x", ["Python"])}
    owner = {r.path: r.component for r in G.component_of_file(f, c, ["repo"]).collect()}
    assert owner["app/src/orders/f1.py"] == "c-app-src-orders" and owner["app/setup.cfg"] == "c-app"


def test_merge_small(spark):
    from pyspark.sql import functions as F

    f = files(spark, *[f"d{i:02d}/f{j}.py" for i in range(50) for j in range(1 + i % 3)]).withColumn("root", F.lit("")).withColumn("app", F.lit("a"))
    apps = spark.createDataFrame([("r", "a", "A")], "repo string, id string, name string")
    c = G.components(f, apps, ["repo"], max_components=10).collect()
    assert len(c) == 10 and sum(r.files for r in c) == f.count()
    assert [r.description for r in c if r.name == "(other)"] == ["41 small directories together"]


def test_readme_and_nouns(spark):
    md = "# Title\n\n[![b](x)](y) [![c](z)](w)\n> quote\n\nThe **order** [service](http://x) does\nthings.\n\nSecond.\n"
    df = spark.createDataFrame([(md,)], "t string")
    assert df.select(G.readme_summary("t")).first()[0] == "The order service does things."
    ep = spark.createDataFrame([("r", "/api/orders/{id}", "get_order"), ("r", "/v1/invoices", "listInvoices")], "repo string, path string, handler string")
    sy = spark.createDataFrame([("r", "x.OrderRepository", "class"), ("r", "Line_Item", "table"), ("r", "f", "function")], "repo string, name string, kind string")
    got = {r.noun: r.weight for r in G.noun_weights(ep, sy, ["repo"]).collect()}
    assert got == {"order": 6, "get": 1, "invoice": 4, "list": 1, "line": 2, "item": 2}
    assert [(r.noun, r["rank"]) for r in G.domain_nouns(ep, sy, ["repo"], 2).orderBy("rank").collect()] == [("order", 1), ("invoice", 2)]


def test_styles(spark):
    df = spark.createDataFrame([(["models", "views", "controllers"], ["Django"]), (["x"], []), (["events"], [])], "d array<string>, f array<string>")
    got = [r[0] for r in df.select(G.architecture_style(df.d, df.f)).collect()]
    assert got == ["MVC + Framework MVC (batteries included)", "Unclassified (flat or ad-hoc layout)", "Event-driven"]
