from pyspark.sql import functions as F

from codecensus.operators import resolve as R
from codecensus.operators.manifests import manifests, ts_aliases
from codecensus.sources import files as S


def raw(spark, *paths, size=10):
    rows = [("r", p, size, t) for p, t in ((x if isinstance(x, tuple) else (x, "x\n")) for x in paths)]
    return spark.createDataFrame(rows, "repo string, path string, size long, text string")


def test_ignore_and_classify(spark):
    df = raw(
        spark, (".gitignore", "# c\n*.tmp\n!keep.tmp\nsecret/\n/rooted.txt\ndocs/*.pdfx\nlogs\n"), ("sub/.gitignore", "local.py\n"),
        "a.py", "x.tmp", "keep.tmp", "secret/a.py", "secret/keep.tmp", "rooted.txt", "in/rooted.txt", "docs/a.pdfx", "docs/in/b.pdfx", "logs", "deep/logs/x.py",
        "sub/local.py", "local.py", "node_modules/m/i.js", "src/dist/o.js", ".github/workflows/ci.yml", ".hidden/x.py", "a.min.js",
        "proj/A.csproj", "proj/bin/D.cs", "tool/bin/run.sh", "tests/test_a.py", "Dockerfile", "infra/main.tf", "README.md", "package.json", "conf/app.yaml", "data.bin2")
    tagged = S.tag_files(df, S.ignore_rules(df))
    cause = {r.path: r.cause for r in tagged.collect()}
    for p in ["a.py", "keep.tmp", "in/rooted.txt", "local.py", ".github/workflows/ci.yml", "tool/bin/run.sh", "tests/test_a.py"]:
        assert cause[p] == "", (p, cause[p])
    for p in ["x.tmp", "secret/a.py", "secret/keep.tmp", "rooted.txt", "docs/a.pdfx", "docs/in/b.pdfx", "logs", "deep/logs/x.py", "sub/local.py"]:
        assert cause[p] == "gitignore", (p, cause[p])
    assert cause["node_modules/m/i.js"] == "vendored" and cause["src/dist/o.js"] == "ignored_dir" and cause[".hidden/x.py"] == "ignored_dir"
    assert cause["a.min.js"] == "ignored_glob" and cause["proj/bin/D.cs"] == "ignored_dir"
    st = S.walk_stats(tagged).first()
    assert (st.vendored, st.skipped_dirs) == (1, 3)
    inv = {r.path: (r.language, r.kind) for r in S.inventory(df, tagged).collect()}
    assert inv["a.py"] == ("Python", "source") and inv["tests/test_a.py"] == ("Python", "test") and inv["Dockerfile"] == ("Dockerfile", "infra")
    assert inv["infra/main.tf"][1] == "infra" and inv["README.md"] == ("Markdown", "docs") and inv["package.json"] == ("JSON", "build")
    assert inv["conf/app.yaml"] == ("YAML", "config") and inv["data.bin2"] == ("Unknown", "data")
    assert S.inventory(df, tagged, include_tests=False).where("kind='test'").count() == 0


def test_decode_and_lines(spark):
    df = spark.createDataFrame([(bytearray("é\n# c\n\nx".encode()),), (bytearray(b"\xe9\n"),), (bytearray(b"a\0b"),)], "content binary")
    assert [r[0] for r in df.select(S.decode()).collect()] == ["é\n# c\n\nx", "é\n", ""]


def test_read_repositories(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.py").write_text("y" * 50)
    (tmp_path / "two" / "late.py").write_bytes(b"a" * 5000 + b"\0")
    df = S.read_repositories(spark, str(tmp_path))
    assert {(r.repo, r.path, r.size) for r in df.collect()} == {("one", "src/a.py", 6), ("two", "b.py", 50), ("two", "late.py", 5001)}
    tagged = S.tag_files(df, max_file_size=20)
    assert {(r.repo, r.total_seen, r.kept, r.skipped_large) for r in S.walk_stats(tagged).collect()} == {("one", 1, 1, 0), ("two", 2, 0, 2)}
    assert [(r.path, r.text) for r in S.inventory(df, tagged).collect()] == [("src/a.py", "x = 1\n")]
    # A NUL anywhere makes a file binary.
    assert {r.path: r.text for r in S.inventory(df, S.tag_files(df)).collect()}["late.py"] == ""


def test_texts_are_not_shuffled(spark):
    df = raw(spark, "a/x.py", "node_modules/y.js", "b/skip.py")
    plan = S.inventory(df, S.tag_files(df, S.ignore_rules(df)))._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("\n") if "Exchange" in line and "BroadcastExchange" not in line and "text" in line]
    assert not above


def resolve(spark, paths, imports, extra=()):
    from codecensus.functions.classify import language

    f = raw(spark, *paths, *extra).withColumn("language", language("path"))
    m = manifests(f, ["repo"])
    imp = spark.createDataFrame([("r", *i) for i in imports], "repo string, file string, language string, module string, line int, raw string, relative boolean")
    out = R.resolve(imp, f, m, ts_aliases(f, ["repo"]), ["repo"])
    return {(r.file, r.module): (r.internal_file or r.external_package or ("stdlib" if r.stdlib else "unresolved"), r.ecosystem) for r in out.collect()}


def test_resolve_languages(spark):
    paths = [
        "app/main.py", "app/db/__init__.py", "app/db/repo.py", "lib/util.py", "web/src/a.ts", "web/src/lib/b.tsx", "web/src/lib/index.ts", "packages/ui/src/index.ts",
        "svc/cmd/main.go", "svc/pkg/x/x.go", "j/src/main/java/com/acme/Repo.java", "j/src/main/java/com/acme/sub/Other.java", "n/Orders.cs", "crates/foo-bar/src/lib.rs",
        "rs/src/main.rs", "rs/src/util.rs", "lib/thing.rb", "c/inc/a.h", "c/main.c", "p/one/dup.h", "p/two/dup.h"]
    extra = [
        ("web/tsconfig.json", '{"compilerOptions":{"paths":{"@/*":["src/*"]}}}'), ("packages/ui/package.json", '{"name":"@acme/ui"}'),
        ("svc/go.mod", "module github.com/acme/svc\n")]
    imports = [
        ("app/main.py", "Python", ".db.repo", 1, "", True), ("app/db/repo.py", "Python", "..main", 1, "", True), ("app/main.py", "Python", "app.db.repo.Thing", 1, "", False),
        ("app/main.py", "Python", "util", 1, "", False), ("app/main.py", "Python", "os.path", 1, "", False), ("app/main.py", "Python", "requests.x", 1, "", False),
        ("app/main.py", "Python", ".nope", 1, "", True), ("app/main.py", "Python", ".db", 1, "", True),
        ("web/src/a.ts", "TypeScript", "./lib/b", 1, "", True), ("web/src/a.ts", "TypeScript", "./lib", 1, "", True), ("web/src/a.ts", "TypeScript", "@/lib/b", 1, "", False),
        ("web/src/a.ts", "TypeScript", "@acme/ui/x", 1, "", False), ("web/src/a.ts", "TypeScript", "node:fs", 1, "", False), ("web/src/a.ts", "TypeScript", "lodash/get", 1, "", False),
        ("web/src/a.ts", "TypeScript", "https://x.y/z", 1, "", False), ("web/src/a.ts", "TypeScript", "../../gone", 1, "", True),
        ("svc/cmd/main.go", "Go", "github.com/acme/svc/pkg/x", 1, "", False), ("svc/cmd/main.go", "Go", "fmt", 1, "", False), ("svc/cmd/main.go", "Go", "github.com/a/b/c/d", 1, "", False),
        ("svc/cmd/main.go", "Go", "github.com/acme/svc/none", 1, "", False),
        ("j/src/main/java/com/acme/Repo.java", "Java", "com.acme.sub.Other", 1, "", False), ("j/src/main/java/com/acme/Repo.java", "Java", "com.*", 1, "", False),
        ("j/src/main/java/com/acme/Repo.java", "Java", "java.util.List", 1, "", False), ("j/src/main/java/com/acme/Repo.java", "Java", "org.x.y.Z", 1, "", False),
        ("n/Orders.cs", "C#", "Acme.Orders", 1, "", False), ("n/Orders.cs", "C#", "System.Text", 1, "", False), ("n/Orders.cs", "C#", "Dapper", 1, "", False),
        ("rs/src/main.rs", "Rust", "foo_bar", 1, "", False), ("rs/src/main.rs", "Rust", "util", 1, "", True), ("rs/src/main.rs", "Rust", "std", 1, "", False), ("rs/src/main.rs", "Rust", "serde", 1, "", False),
        ("rs/src/main.rs", "Rust", "crate", 1, "", False),
        ("app.rb", "Ruby", "thing", 1, "", False), ("app.rb", "Ruby", "rails/all", 1, "", False), ("c/main.c", "C", "inc/a.h", 1, "", True), ("c/main.c", "C", "dup.h", 1, "", True),
    ]
    got = resolve(spark, paths, imports, extra)
    want = {
        ("app/main.py", ".db.repo"): "app/db/repo.py", ("app/db/repo.py", "..main"): "app/main.py", ("app/main.py", "app.db.repo.Thing"): "app/db/repo.py",
        ("app/main.py", "util"): "lib/util.py", ("app/main.py", "os.path"): "stdlib", ("app/main.py", "requests.x"): "requests", ("app/main.py", ".nope"): "unresolved",
        ("app/main.py", ".db"): "app/db/__init__.py", ("web/src/a.ts", "./lib/b"): "web/src/lib/b.tsx", ("web/src/a.ts", "./lib"): "web/src/lib/index.ts",
        ("web/src/a.ts", "@/lib/b"): "web/src/lib/b.tsx", ("web/src/a.ts", "@acme/ui/x"): "packages/ui/src/index.ts", ("web/src/a.ts", "node:fs"): "stdlib",
        ("web/src/a.ts", "lodash/get"): "lodash", ("web/src/a.ts", "https://x.y/z"): "unresolved", ("web/src/a.ts", "../../gone"): "unresolved",
        ("svc/cmd/main.go", "github.com/acme/svc/pkg/x"): "svc/pkg/x/x.go", ("svc/cmd/main.go", "fmt"): "stdlib", ("svc/cmd/main.go", "github.com/a/b/c/d"): "github.com/a/b",
        ("svc/cmd/main.go", "github.com/acme/svc/none"): "unresolved",
        ("j/src/main/java/com/acme/Repo.java", "com.acme.sub.Other"): "j/src/main/java/com/acme/sub/Other.java", ("j/src/main/java/com/acme/Repo.java", "com.*"): "j/src/main/java/com/acme/Repo.java",
        ("j/src/main/java/com/acme/Repo.java", "java.util.List"): "stdlib", ("j/src/main/java/com/acme/Repo.java", "org.x.y.Z"): "org.x.y",
        ("n/Orders.cs", "Acme.Orders"): "n/Orders.cs", ("n/Orders.cs", "System.Text"): "stdlib", ("n/Orders.cs", "Dapper"): "Dapper",
        ("rs/src/main.rs", "foo_bar"): "crates/foo-bar/src/lib.rs", ("rs/src/main.rs", "util"): "rs/src/util.rs", ("rs/src/main.rs", "std"): "stdlib",
        ("rs/src/main.rs", "serde"): "serde", ("rs/src/main.rs", "crate"): "unresolved", ("app.rb", "thing"): "lib/thing.rb", ("app.rb", "rails/all"): "rails",
        ("c/main.c", "inc/a.h"): "c/inc/a.h", ("c/main.c", "dup.h"): "unresolved",
    }
    assert {k: v[0] for k, v in got.items()} == want, {k: (got.get(k), w) for k, w in want.items() if got.get(k, ("",))[0] != w}
    assert got[("web/src/a.ts", "lodash/get")][1] == "npm"


def test_usage_and_edges(spark):
    res = spark.createDataFrame([
        ("r", "a.py", "x", 1, "b.py", "", "", False), ("r", "a.py", "x", 3, "b.py", "", "", False), ("r", "a.py", "q", 2, "", "My_Pkg", "pypi", False), ("r", "a.py", "z", 2, "", "", "", True)],
        "repo string, file string, module string, line int, internal_file string, external_package string, ecosystem string, unresolved boolean")
    e = R.file_edges(res, ["repo"]).first()
    assert (e.source, e.target, e.weight, e.line) == ("a.py", "b.py", 2, 1)
    apps = spark.createDataFrame([("r", "a.py", "app-a")], "repo string, path string, app string")
    u = R.external_usage(res, apps, ["repo"]).first()
    assert (u.name, u.files, u.apps, u.n_files) == ("my-pkg", ["a.py"], ["app-a"], 1)
    assert R.unresolved_counts(res, ["repo"]).first().unresolved_imports == 1
    assert F.lit(1) is not None
