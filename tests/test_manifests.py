from pyspark.sql import functions as F

from codecensus.operators import manifests as M


def files(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], "repo string, path string, text string")


def test_manifests(spark):
    f = files(
        spark,
        ("web/package.json", '{"name":"web","version":"1.0.0","private":true,"workspaces":["packages/*"],"main":"x.js","bin":{"a":"b.js"},'
         '"dependencies":{"react":"^18","lodash":"*"},"devDependencies":{"vite":"5"}}'),
        ("lib/package.json", '{"name":"lib","main":"i.js","dependencies":{"a":{"version":"2"}}}'),
        ("api/pyproject.toml", '[project]\nname = "acme-api"\nversion = "0.1"\ndescription = "An API"\ndependencies = [\n  "fastapi>=0.1",\n  "uvicorn[standard]~=0.2; python_version>\'3\'",\n]\n'
         '[project.optional-dependencies]\ndev = ["pytest"]\nextra = ["boto3==1"]\n[project.scripts]\nacme = "acme:main"\n'),
        ("po/pyproject.toml", '[tool.poetry]\nname = "po"\n[tool.poetry.dependencies]\npython = "^3.9"\nrequests = "^2"\nx = { version = "1.1", extras = ["q"] }\n[tool.poetry.group.dev.dependencies]\nblack = "*"\n'),
        ("requirements-dev.txt", "# c\npytest==7.0 # why\n-r base.txt\ngit+https://h.io/o/tool.git@main\n"),
        ("setup.py", "setup(name='old', version='2', install_requires=['six>=1', 'attrs'])\n"),
        ("Pipfile", '[packages]\nflask = "*"\n[dev-packages]\nmypy = "==1"\n'),
        ("go.mod", "module github.com/acme/svc\n\ngo 1.21\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\nrequire github.com/e/f v2.0.0\n"),
        ("go.work", "go 1.21\nuse (\n\t./a\n\t./b\n)\nuse ./c\n"),
        ("pom.xml", "<project xmlns='http://maven.apache.org/POM/4.0.0'><groupId>com.acme</groupId><artifactId>shop</artifactId><version>1</version><modules><module>core</module></modules>"
         "<dependencies><dependency><groupId>org.x</groupId><artifactId>y</artifactId><version>3</version></dependency>"
         "<dependency><groupId>junit</groupId><artifactId>junit</artifactId><scope>test</scope></dependency></dependencies></project>"),
        ("g/build.gradle", "dependencies {\n  implementation 'org.a:b:1.0'\n  testImplementation(\"j:u:2\")\n}\n"),
        ("settings.gradle", "rootProject.name = 'multi'\ninclude ':app', ':lib:core'\n"),
        ("A/A.csproj", '<Project><PropertyGroup><OutputType>Exe</OutputType></PropertyGroup><ItemGroup><PackageReference Include="Dapper" Version="2.0" /><PackageReference Include="Z"><Version>1.1</Version></PackageReference><ProjectReference Include="..\\B\\B.csproj" /></ItemGroup></Project>'),
        ("x.sln", 'Project("{1}") = "A", "src\\A\\A.csproj", "{2}"\n'),
        ("Cargo.toml", '[package]\nname = "crab"\nversion = "0.3"\n[dependencies]\nserde = { version = "1", features = ["derive"] }\ntokio = "1.2"\n[dev-dependencies]\nq = "1"\n[[bin]]\nname = "c"\n[workspace]\nmembers = ["a", "b"]\n'),
        ("Gemfile", "gem 'rails', '~> 7'\ngem \"pg\"\n"),
        ("x.gemspec", "s.name = 'gemmy'\n"),
        ("composer.json", '{"name":"a/b","require":{"php":">=8","monolog/monolog":"^3","ext-json":"*"},"require-dev":{"phpunit/phpunit":"10"},"license":["MIT","BSD"]}'),
        ("pubspec.yaml", "name: dapp\nversion: 1.0.0\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0.0\ndev_dependencies:\n  lints: 2.0.0\n"),
        ("mix.exs", 'app: :elix\n{:phoenix, "~> 1.7"}\n'),
        ("pnpm-workspace.yaml", "packages:\n  - 'apps/*'\n  - \"libs/*\"\n"),
        ("lerna.json", '{"packages":["modules/*"]}'),
        ("README.md", "hello"),
    )
    m = M.manifests(f, ["repo"]).persist()
    rows = {r.path: r for r in m.collect()}
    assert "README.md" not in rows
    assert (rows["web/package.json"].kind_hint, rows["web/package.json"].workspaces, rows["web/package.json"].dir) == ("frontend", ["packages/*"], "web")
    assert rows["lib/package.json"].kind_hint == "library"
    assert (rows["api/pyproject.toml"].name, rows["api/pyproject.toml"].kind_hint, rows["api/pyproject.toml"].entrypoints) == ("acme-api", "cli", ["acme:main"])
    assert rows["go.mod"].module_path == "github.com/acme/svc" and rows["go.mod"].name == "svc"
    assert rows["go.work"].workspaces == ["./a", "./b", "./c"]
    assert (rows["pom.xml"].name, rows["pom.xml"].module_path, rows["pom.xml"].workspaces) == ("shop", "com.acme", ["core"])
    assert (rows["settings.gradle"].name, rows["settings.gradle"].workspaces) == ("multi", ["app", "lib/core"])
    assert (rows["A/A.csproj"].kind_hint, rows["A/A.csproj"].entrypoints) == ("cli", ["../B/B.csproj"])
    assert rows["x.sln"].workspaces == ["src/A"]
    assert (rows["Cargo.toml"].kind_hint, rows["Cargo.toml"].workspaces) == ("cli", ["a", "b"])
    assert (rows["x.gemspec"].name, rows["composer.json"].license) == ("gemmy", "MIT, BSD")
    assert rows["pnpm-workspace.yaml"].workspaces == ["apps/*", "libs/*"] and rows["lerna.json"].workspaces == ["modules/*"]
    assert rows["mix.exs"].name == "elix" and rows["pubspec.yaml"].name == "dapp"
    got = {(r.declared_in, r.name, r.version, r.scope, r.direct) for r in M.declared(m, ["repo"]).collect()}
    want = {
        ("web/package.json", "react", "^18", "runtime", True), ("web/package.json", "lodash", "*", "runtime", True), ("web/package.json", "vite", "5", "dev", True),
        ("lib/package.json", "a", "2", "runtime", True),
        ("api/pyproject.toml", "fastapi", ">=0.1", "runtime", True), ("api/pyproject.toml", "uvicorn", "~=0.2", "runtime", True),
        ("api/pyproject.toml", "pytest", "", "dev", True), ("api/pyproject.toml", "boto3", "==1", "optional", True),
        ("po/pyproject.toml", "requests", "^2", "runtime", True), ("po/pyproject.toml", "x", "1.1", "runtime", True), ("po/pyproject.toml", "black", "*", "dev", True),
        ("requirements-dev.txt", "pytest", "==7.0", "dev", True), ("requirements-dev.txt", "tool", "", "dev", True),
        ("setup.py", "six", ">=1", "runtime", True), ("setup.py", "attrs", "", "runtime", True),
        ("Pipfile", "flask", "*", "runtime", True), ("Pipfile", "mypy", "==1", "dev", True),
        ("go.mod", "github.com/a/b", "v1.2.3", "runtime", True), ("go.mod", "github.com/c/d", "v0.1.0", "runtime", False), ("go.mod", "github.com/e/f", "v2.0.0", "runtime", True),
        ("pom.xml", "org.x:y", "3", "runtime", True), ("pom.xml", "junit:junit", "", "test", True),
        ("g/build.gradle", "org.a:b", "1.0", "runtime", True), ("g/build.gradle", "j:u", "2", "test", True),
        ("A/A.csproj", "Dapper", "2.0", "runtime", True), ("A/A.csproj", "Z", "1.1", "runtime", True),
        ("Cargo.toml", "serde", "1", "runtime", True), ("Cargo.toml", "tokio", "1.2", "runtime", True), ("Cargo.toml", "q", "1", "dev", True),
        ("Gemfile", "rails", "~> 7", "runtime", True), ("Gemfile", "pg", "", "runtime", True),
        ("composer.json", "monolog/monolog", "^3", "runtime", True), ("composer.json", "phpunit/phpunit", "10", "dev", True),
        ("pubspec.yaml", "flutter", "", "runtime", True), ("pubspec.yaml", "http", "^1.0.0", "runtime", True), ("pubspec.yaml", "lints", "2.0.0", "dev", True),
        ("mix.exs", "phoenix", "~> 1.7", "runtime", True),
    }
    assert got == want, (got - want, want - got)


def test_lockfiles(spark):
    f = files(
        spark,
        ("package-lock.json", '{"packages":{"":{"name":"r"},"node_modules/a":{"version":"1.0"},"node_modules/a/node_modules/@s/b":{"version":"2","dev":true}}}'),
        ("old/package-lock.json", '{"dependencies":{"a":{"version":"1","dependencies":{"c":{"version":"3"}}}}}'),
        ("yarn.lock", '# v1\n\n"@s/a@^1.0.0", "@s/a@^1.1.0":\n  version "1.1.2"\n  resolved "x"\n\nb@2:\n  version "2.0.1"\n'),
        ("pnpm-lock.yaml", "packages:\n  /a@1.2.3:\n    x: y\n  /@s/b@2.0.0:\n"),
        ("poetry.lock", '[[package]]\nname = "a"\nversion = "1"\ncategory = "dev"\n\n[[package]]\nname = "b"\nversion = "2"\n\n[metadata]\nname = "no"\n'),
        ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n'),
        ("Gemfile.lock", "GEM\n  remote: x\n  specs:\n    rails (7.0.1)\n      rack (>= 2)\n    pg (1.5)\n\nPLATFORMS\n  ruby (1)\n"),
        ("composer.lock", '{"packages":[{"name":"m/m","version":"3.1"}],"packages-dev":[{"name":"p/p","version":"10"}]}'),
        ("go.sum", "github.com/a/b v1.0.0 h1:x\ngithub.com/a/b v1.0.0/go.mod h1:y\ngithub.com/c/d v0.2.0/go.mod h1:z\n"),
        ("packages.lock.json", '{"dependencies":{"net8":{"Dapper":{"type":"Direct","resolved":"2.1"},"Q":{"type":"Transitive","resolved":"1"}}}}'),
        ("pubspec.lock", 'packages:\n  http:\n    dependency: "direct main"\n    version: "1.1.0"\n  path:\n    version: "1.8"\n'),
    )
    got = {(r.declared_in, r.name, r.version, r.scope, r.direct) for r in M.locked(f, ["repo"]).collect()}
    want = {
        ("package-lock.json", "a", "1.0", "runtime", False), ("package-lock.json", "@s/b", "2", "dev", False),
        ("old/package-lock.json", "a", "1", "runtime", False), ("old/package-lock.json", "c", "3", "runtime", False),
        ("yarn.lock", "@s/a", "1.1.2", "runtime", False), ("yarn.lock", "b", "2.0.1", "runtime", False),
        ("pnpm-lock.yaml", "a", "1.2.3", "runtime", False), ("pnpm-lock.yaml", "@s/b", "2.0.0", "runtime", False),
        ("poetry.lock", "a", "1", "dev", False), ("poetry.lock", "b", "2", "runtime", False),
        ("Cargo.lock", "serde", "1.0.1", "runtime", False), ("Gemfile.lock", "rails", "7.0.1", "runtime", False), ("Gemfile.lock", "pg", "1.5", "runtime", False),
        ("composer.lock", "m/m", "3.1", "runtime", False), ("composer.lock", "p/p", "10", "dev", False),
        ("go.sum", "github.com/a/b", "v1.0.0", "runtime", False), ("go.sum", "github.com/c/d", "v0.2.0", "runtime", False),
        ("packages.lock.json", "Dapper", "2.1", "runtime", True), ("packages.lock.json", "Q", "1", "runtime", False),
        ("pubspec.lock", "http", "1.1.0", "runtime", False), ("pubspec.lock", "path", "1.8", "runtime", False),
    }
    assert got == want, (got - want, want - got)


def test_ts_aliases(spark):
    f = files(spark, ("apps/web/tsconfig.json", '{"compilerOptions":{"baseUrl":".","paths":{"@/*":["./src/*"],"shared":["../../packages/shared"]}}}'),
              ("b/tsconfig.json", '{"compilerOptions":{"baseUrl":"src"}}'))
    got = {(r.path, r.prefix, r.target) for r in M.ts_aliases(f, ["repo"]).collect()}
    assert got == {("apps/web/tsconfig.json", "@/", "apps/web/src"), ("apps/web/tsconfig.json", "shared", "packages/shared"),
                   ("b/tsconfig.json", "~/", "b/src"), ("b/tsconfig.json", "@/", "b/src")}


def test_formats_of_the_caller(spark):
    from codecensus.operators.manifests import extra_dependencies
    from codecensus.operators.windows import select_by

    df = spark.createDataFrame([("r", "a/Deps.list", "x 1.0\ny 2.0\n"), ("r", "other.txt", "z 3.0")], "repo string, path string, text string")
    lines = lambda text: F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.struct(
        F.substring_index(x, " ", 1).alias("name"), F.substring_index(x, " ", -1).alias("version"), F.lit("runtime").alias("scope"), F.lit(True).alias("direct")))
    got = extra_dependencies(df, ["repo"], {"deps.list": ("pypi", lines)})
    assert [(r.declared_in, r.ord, r.name, r.version, r.ecosystem, r.purl) for r in got.orderBy("ord").collect()] == [
        ("a/Deps.list", 0, "x", "1.0", "pypi", "pkg:pypi/x@1.0"), ("a/Deps.list", 1, "y", "2.0", "pypi", "pkg:pypi/y@2.0")]
    assert [r.name for r in select_by(got, name=["y"], version=None).collect()] == ["y"] and select_by(got, name=[]).collect() == []
