"""Package manifests and lockfiles: file rows in, manifest and dependency rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions import formats as M
from codecensus.functions.packages import clean_version, purl, requirement_parts
from codecensus.functions.text import basename, dirname, lines
from codecensus.session import cut

Keys = list[str]
DEP = "struct<name:string,version:string,scope:string,direct:boolean>"
NO_DEPS = f"cast(array() as array<{DEP}>)"

# Manifest and lockfile names.
NPM_SECTIONS = (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional"))
FRONTEND_PACKAGES = ("react", "vue", "svelte", "@angular/core", "next", "nuxt")
SERVICE_PACKAGES = ("express", "fastify", "@nestjs/core", "koa", "hapi")
DEV_GROUPS = ("dev", "test", "tests", "lint", "docs")
MANIFEST_NAMES = {
    "package.json": "npm", "pyproject.toml": "pyproject", "setup.py": "setup", "pipfile": "pipfile", "go.mod": "gomod",
    "go.work": "gowork", "pom.xml": "pom", "build.gradle": "gradle", "build.gradle.kts": "gradle",
    "settings.gradle": "gradle_settings", "settings.gradle.kts": "gradle_settings", "cargo.toml": "cargo",
    "gemfile": "gemfile", "composer.json": "composer", "pubspec.yaml": "pubspec", "mix.exs": "mix",
    "pnpm-workspace.yaml": "pnpm_workspace", "lerna.json": "lerna",
}
LOCK_NAMES = {
    "package-lock.json": "npm_lock", "npm-shrinkwrap.json": "npm_lock", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm",
    "poetry.lock": "poetry", "cargo.lock": "cargo_lock", "gemfile.lock": "gem_lock", "composer.lock": "composer_lock",
    "go.sum": "gosum", "packages.lock.json": "nuget_lock", "pubspec.lock": "pub_lock",
}
ECOSYSTEM = {
    "npm": "npm", "lerna": "npm", "pnpm_workspace": "npm", "pyproject": "pypi", "setup": "pypi", "pipfile": "pypi", "requirements": "pypi",
    "gomod": "go", "gowork": "go", "pom": "maven", "gradle": "maven", "gradle_settings": "maven", "csproj": "nuget", "sln": "nuget",
    "cargo": "cargo", "gemfile": "rubygems", "gemspec": "rubygems", "composer": "composer", "pubspec": "pub", "mix": "hex",
    "npm_lock": "npm", "yarn": "npm", "pnpm": "npm", "poetry": "pypi", "cargo_lock": "cargo", "gem_lock": "rubygems",
    "composer_lock": "composer", "gosum": "go", "nuget_lock": "nuget", "pub_lock": "pub",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def manifest_format(path: Column | str) -> Column:
    """Name of the manifest parser for a path, NULL for other files."""
    name = F.lower(basename(path))
    return F.coalesce(
        _lookup(MANIFEST_NAMES, name),
        F.when(name.startswith("requirements") & name.endswith(".txt"), "requirements")
        .when(name.rlike(r"\.(cs|fs|vb)proj$"), "csproj").when(name.endswith(".sln"), "sln").when(name.endswith(".gemspec"), "gemspec"))


def lock_format(path: Column | str) -> Column:
    return _lookup(LOCK_NAMES, F.lower(basename(path)))


def _dep(name: Column, version: Column | str = "", scope: Column | str = "runtime", direct: Column | bool = True) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.btrim(name).alias("name"), F.btrim(F.coalesce(lit(version), F.lit(""))).alias("version"), lit(scope).alias("scope"), lit(direct).alias("direct"))


def _concat(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.expr(NO_DEPS)) for a in arrays])


def _json(schema: str, text: Column) -> Column:
    return F.from_json(text, schema, {"allowComments": "true", "mode": "PERMISSIVE"})


def _map_deps(m: Column, scope: str) -> Column:
    version = lambda v: F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.version"), F.get_json_object(v, "$.rev"), F.lit(""))).otherwise(v)
    return F.transform(F.map_entries(m), lambda e: _dep(e["key"], version(F.coalesce(e["value"], F.lit(""))), scope))


def _req_deps(raw: Column, scope: Column | str) -> Column:
    parts = F.transform(raw, requirement_parts)
    return F.transform(F.filter(parts, lambda p: p["name"] != ""), lambda p: _dep(p["name"], p["version"], scope))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _one(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _s(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


NPM_SCHEMA = (
    "name string, version string, description string, private boolean, license string, workspaces string, main string, module string, bin string, "
    + ", ".join(f"{k} map<string,string>" for k, _ in NPM_SECTIONS)
)


def manifests(files: DataFrame, keys: Keys) -> DataFrame:
    """One row per manifest with its dependencies as an array (bounded by the file)."""
    text, path = F.col("text"), F.col("path")
    src = (
        files.withColumn("format", manifest_format("path")).where(F.col("format").isNotNull() & (text != ""))
        .select(*keys, "path", "text", "format")
    )
    fmt = F.col("format")
    parsed = src.select(
        *keys, "path", "format", "text",
        F.when(fmt == "npm", _json(NPM_SCHEMA, text)).alias("npm"),
        F.when(fmt == "composer", _json("name string, description string, license string, require map<string,string>, `require-dev` map<string,string>", text)).alias("php"),
        F.when(fmt.isin("pyproject", "pipfile", "cargo"), M.toml_sections(text)).alias("toml"),
        F.when(fmt.isin("pubspec", "pnpm_workspace"), M.yaml_blocks(M.yaml_even(text), 0)).alias("yaml"),
        F.lower(basename(path)).alias("file"),
    )
    toml, yaml = F.col("toml"), F.col("yaml")
    project, poetry, package = (M.toml_body(toml, h) for h in ("project", "tool.poetry", "package"))

    # --- dependencies
    npm_deps = _concat(*[_map_deps(F.col(f"npm.{k}"), scope) for k, scope in NPM_SECTIONS])
    optional = M.toml_body(toml, "project.optional-dependencies")
    groups = _all(optional, r"""(?m)^[ \t]*[\w\-]+[ \t]*=[ \t]*\[(?:[^\]"']++|"[^"]*+"|'[^']*+')*+\]""", 0)
    opt_deps = F.flatten(F.transform(groups, lambda g: _req_deps(
        _all(F.regexp_replace(g, r"^[^=]*=", ""), r"""["']([^"'\n]*)["']""", 1),
        F.when(_one(g, r"^[ \t]*([\w\-]+)").isin(*DEV_GROUPS), "dev").otherwise("optional"))))

    def pair_deps(header: str, scope: str) -> Column:
        return F.transform(M.toml_pairs(M.toml_body(toml, header)), lambda p: _dep(p["name"], M.toml_version(p["value"]), scope))

    poetry_deps = F.filter(pair_deps("tool.poetry.dependencies", "runtime"), lambda d: F.lower(d["name"]) != "python")
    group_deps = F.flatten(F.transform(
        F.filter(toml, lambda s: s["header"].rlike(r"^tool\.poetry\.group\.[^.]+\.dependencies$")),
        lambda s: F.transform(M.toml_pairs(s["body"]), lambda p: _dep(p["name"], M.toml_version(p["value"]), "dev"))))
    py_deps = _concat(_req_deps(M.toml_strings(project, "dependencies"), "runtime"), opt_deps, poetry_deps, group_deps)

    req_scope = F.when(F.col("file").rlike(r"(?i)(dev|test|lint|doc)"), "dev").otherwise("runtime")
    req_lines = F.filter(
        F.transform(lines(text), lambda l: F.btrim(F.substring_index(l, "#", 1), F.lit(" \t\r"))),
        lambda l: (l != "") & ~l.startswith("-"))
    url = lambda l: l.startswith("git+") | l.startswith("http")
    req_deps = F.filter(F.transform(req_lines, lambda l: F.when(
        url(l), _dep(F.substring_index(F.substring_index(l, "/", -1), ".git", 1), "", req_scope)
    ).otherwise(_dep(requirement_parts(l)["name"], requirement_parts(l)["version"], req_scope))), lambda d: d["name"] != "")

    setup_deps = _req_deps(_all(_one(text, r"""(?s)install_requires\s*=\s*\[((?:[^\]"']++|"[^"]*+"|'[^']*+')*+)\]"""), r"""["']([^"']+)["']""", 1), "runtime")
    pip_deps = _concat(pair_deps("packages", "runtime"), pair_deps("dev-packages", "dev"))
    # A require block, or one require line; "// indirect" marks what is not used directly.
    block_lines = F.flatten(F.transform(_all(text, r"(?m)^[ \t]*require[ \t]*\(([^)]*)\)", 1), lambda b: F.split(b, "\n")))
    go_lines = F.concat(block_lines, _all(text, r"(?m)^[ \t]*require[ \t]+([^(\s][^\n]*)$", 1))
    go_deps = F.transform(
        F.filter(go_lines, lambda l: l.rlike(r"^\s*[^\s/]\S*\s+v\S")),
        lambda l: _dep(_one(l, r"^\s*(\S+)"), _one(l, r"^\s*\S+\s+(v\S+)"), "runtime", ~l.contains("// indirect")))
    ns = lambda tag: f"*[local-name()='{tag}']"
    xml = F.when(fmt.isin("pom", "csproj"), F.regexp_replace(text, r"<!DOCTYPE[^>]*>|\A\x{FEFF}", ""))
    # xpath drops empty nodes, so every dependency element is read as its own fragment.
    pom_head = F.regexp_replace(xml, r"(?s)<(dependencyManagement|build|profiles|parent|dependencies)\b.*?</\1>", "")
    pom_body = F.regexp_replace(xml, r"(?s)<(dependencyManagement|build|profiles)\b.*?</\1>", "")
    pom_deps = F.transform(
        F.filter(_all(pom_body, r"(?s)<dependency>(.*?)</dependency>", 1), lambda d: d.contains("<artifactId>")),
        lambda d: _dep(
            F.concat_ws(":", F.nullif(_one(d, r"<groupId>\s*([^<]*?)\s*</groupId>"), F.lit("")), _one(d, r"<artifactId>\s*([^<]*?)\s*</artifactId>")),
            _one(d, r"<version>\s*([^<]*?)\s*</version>"),
            F.when(_one(d, r"<scope>\s*([^<]*?)\s*</scope>") == "test", "test").otherwise("runtime")))
    gradle = r"""(?m)^\s*(implementation|api|compile|runtimeOnly|testImplementation|testCompile|kapt|annotationProcessor)\s*[\( ]\s*["']([^"':]+):([^"':]+)(?::([^"']+))?["']"""
    gradle_deps = F.transform(_all(text, gradle, 0), lambda m: _dep(
        F.concat(_one(m, gradle, 2), F.lit(":"), _one(m, gradle, 3)), _one(m, gradle, 4),
        F.when(_one(m, gradle, 1).startswith("test"), "test").otherwise("runtime")))
    refs = _all(xml, r"(?s)<PackageReference\b[^>]*?(?:/>|>.*?</PackageReference>)", 0)
    cs_deps = F.filter(F.transform(refs, lambda r: _dep(
        _one(r, r"""(?:Include|Update)\s*=\s*["']([^"']*)["']"""),
        F.coalesce(F.nullif(_one(r, r"""\bVersion\s*=\s*["']([^"']*)["']"""), F.lit("")), _one(r, r"<Version>\s*([^<]*?)\s*</Version>")))),
        lambda d: d["name"] != "")
    cargo_deps = _concat(pair_deps("dependencies", "runtime"), pair_deps("dev-dependencies", "dev"), pair_deps("build-dependencies", "build"))
    gem = r"""(?m)^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?"""
    gem_deps = F.transform(_all(text, gem, 0), lambda m: _dep(_one(m, gem, 1), _one(m, gem, 2)))
    php_deps = F.filter(_concat(_map_deps(F.col("php.require"), "runtime"), _map_deps(F.col("php.require-dev"), "dev")),
                        lambda d: (F.lower(d["name"]) != "php") & ~d["name"].startswith("ext-"))

    def yaml_deps(key: str, scope: str) -> Column:
        return F.transform(M.yaml_blocks(M.yaml_inner(M.yaml_child(yaml, key)), 1), lambda b: _dep(
            M.yaml_key(b), F.when(M.yaml_scalar(b) != "", M.yaml_scalar(b)).otherwise(
                unq(_one(M.yaml_inner(b), r"(?m)^\s*version:[ \t]*([^\n]*)"))), scope))

    unq = M.unquote
    pub_deps = _concat(yaml_deps("dependencies", "runtime"), yaml_deps("dev_dependencies", "dev"))
    mix = r"""\{\s*:(\w+)\s*,\s*"([^"]+)\""""
    mix_deps = F.transform(_all(text, mix, 0), lambda m: _dep(_one(m, mix, 1), _one(m, mix, 2)))
    deps = F.when(F.lit(False), F.expr(NO_DEPS))
    for name, col in (("npm", npm_deps), ("pyproject", py_deps), ("requirements", req_deps), ("setup", setup_deps), ("pipfile", pip_deps),
                      ("gomod", go_deps), ("pom", pom_deps), ("gradle", gradle_deps), ("csproj", cs_deps), ("cargo", cargo_deps),
                      ("gemfile", gem_deps), ("composer", php_deps), ("pubspec", pub_deps), ("mix", mix_deps)):
        deps = deps.when(fmt == name, col)

    # --- header fields
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    has_project = F.exists(toml, lambda s: s["header"] == "project")
    py_head = F.when(has_project, project).otherwise(poetry)
    scripts = F.when(has_project, M.toml_body(toml, "project.scripts")).otherwise(M.toml_body(toml, "tool.poetry.scripts"))
    script_values = F.transform(M.toml_pairs(scripts), lambda p: unq(p["value"]))
    xroot = lambda tag: F.btrim(_one(pom_head, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"))
    module = _one(text, r"(?m)^module\s+(\S+)")
    name = (
        F.when(fmt == "npm", _s(F.col("npm.name"))).when(fmt == "pyproject", M.toml_value(py_head, "name"))
        .when(fmt == "setup", _one(text, r"""name\s*=\s*["']([^"']+)["']""")).when(fmt == "gomod", F.substring_index(module, "/", -1))
        .when(fmt == "gowork", "go-workspace").when(fmt == "pom", F.coalesce(F.nullif(xroot("name"), F.lit("")), xroot("artifactId")))
        .when(fmt == "gradle_settings", _one(text, r"""rootProject\.name\s*=\s*["']([^"']+)["']"""))
        .when(fmt.isin("csproj", "sln"), stem).when(fmt == "cargo", M.toml_value(package, "name"))
        .when(fmt == "gemspec", _one(text, r"""\.name\s*=\s*["']([^"']+)""")).when(fmt == "composer", _s(F.col("php.name")))
        .when(fmt == "pubspec", M.yaml_scalar(M.yaml_child(yaml, "name"))).when(fmt == "mix", _one(text, r"app:\s*:(\w+)"))
        .when(fmt.isin("lerna", "pnpm_workspace"), "workspace").otherwise(""))
    version = (
        F.when(fmt == "npm", _s(F.col("npm.version"))).when(fmt == "pyproject", M.toml_value(py_head, "version"))
        .when(fmt == "setup", _one(text, r"""version\s*=\s*["']([^"']+)["']""")).when(fmt == "pom", xroot("version"))
        .when(fmt == "cargo", M.toml_value(package, "version")).when(fmt == "pubspec", M.yaml_scalar(M.yaml_child(yaml, "version"))).otherwise(""))
    description = (
        F.when(fmt == "npm", _s(F.col("npm.description"))).when(fmt == "pyproject", M.toml_value(py_head, "description"))
        .when(fmt == "pom", xroot("description")).when(fmt == "cargo", M.toml_value(package, "description"))
        .when(fmt == "composer", _s(F.col("php.description"))).when(fmt == "pubspec", M.yaml_scalar(M.yaml_child(yaml, "description"))).otherwise(""))
    php_license = F.coalesce(F.array_join(F.from_json(F.col("php.license"), "array<string>"), ", "), F.col("php.license"))
    license_ = (
        F.when(fmt == "npm", _s(F.col("npm.license"))).when(fmt == "cargo", M.toml_value(package, "license"))
        .when(fmt == "composer", _s(php_license))
        .when(fmt == "pyproject", F.coalesce(
            F.nullif(M.toml_value(py_head, "license"), F.lit("")),
            _one(py_head, r"""(?m)^[ \t]*license[ \t]*=[ \t]*\{[^}\n]*(?:text|file)[ \t]*=[ \t]*["']([^"']*)["']"""))).otherwise(""))
    ws_json = F.coalesce(
        F.from_json(F.col("npm.workspaces"), "array<string>"), F.from_json(F.get_json_object("npm.workspaces", "$.packages"), "array<string>"))
    includes = F.flatten(F.transform(_all(text, r"include\s*\(?\s*([^)\n]+)", 1), lambda m: F.split(m, ",")))
    workspaces = (
        F.when(fmt == "npm", ws_json).when(fmt == "lerna", F.from_json(F.get_json_object("text", "$.packages"), "array<string>"))
        .when(fmt == "gowork", F.concat(
            F.filter(F.flatten(F.transform(_all(text, r"(?s)use\s*\(([^)]*)\)", 1), lambda b: F.transform(F.split(b, "\n"), lambda l: F.btrim(l, F.lit(" \t\r"))))), lambda l: l != ""),
            _all(text, r"(?m)^use\s+([^\s(]\S*)\s*$", 1)))
        .when(fmt == "pom", _all(_one(xml, r"(?s)<modules>(.*?)</modules>"), r"<module>\s*([^<]+?)\s*</module>", 1))
        .when(fmt == "gradle_settings", F.filter(F.transform(includes, lambda t: F.replace(
            F.ltrim(unq(t), F.lit(":")), F.lit(":"), F.lit("/"))), lambda t: t != ""))
        .when(fmt == "sln", F.transform(_all(text, r'"([^"]+\.(?:cs|fs|vb)proj)"', 1), lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"/[^/]*$", "")))
        .when(fmt == "cargo", M.toml_strings(M.toml_body(toml, "workspace"), "members"))
        .when(fmt == "pnpm_workspace", M.yaml_items(M.yaml_child(yaml, "packages"), 1)))
    bins = F.map_values(F.from_json(F.col("npm.bin"), "map<string,string>"))
    npm_bin = F.when(F.col("npm.bin").startswith("{"), bins).when(F.col("npm.bin").isNotNull(), F.array("npm.bin"))
    entry = (
        F.when(fmt == "npm", F.concat(F.array_compact(F.array("npm.main", "npm.module")), F.coalesce(npm_bin, M.empty_strings())))
        .when(fmt == "pyproject", script_values)
        .when(fmt == "csproj", F.transform(_all(xml, r"""<ProjectReference\b[^>]*Include\s*=\s*["']([^"']+)["']""", 1), lambda p: F.replace(p, F.lit("\\"), F.lit("/")))))
    names = F.transform("deps", lambda d: d["name"])
    output = F.lower(_one(xml, r"<OutputType>\s*([^<]*?)\s*</OutputType>"))
    hint = (
        F.when((fmt == "npm") & F.arrays_overlap(names, F.array(*[F.lit(x) for x in FRONTEND_PACKAGES])), "frontend")
        .when((fmt == "npm") & F.arrays_overlap(names, F.array(*[F.lit(x) for x in SERVICE_PACKAGES])), "service")
        .when((fmt == "npm") & F.col("npm.bin").isNotNull(), "cli")
        .when((fmt == "npm") & ~F.coalesce("npm.private", F.lit(False)) & F.col("npm.main").isNotNull(), "library")
        .when((fmt == "pyproject") & (F.size(script_values) > 0), "cli")
        .when((fmt == "csproj") & (output != ""), F.when(output == "exe", "cli").otherwise("library"))
        .when((fmt == "cargo") & F.exists(toml, lambda s: s["header"] == "bin"), "cli").otherwise(""))
    readable = ~(fmt.isin("npm") & F.col("npm").isNull()) & ~((fmt == "requirements") & (F.size("deps") == 0))
    return parsed.withColumn("deps", F.coalesce(deps, F.expr(NO_DEPS))).where(readable).select(
        *keys, "path", dirname("path").alias("dir"), _lookup(ECOSYSTEM, fmt).alias("ecosystem"), _s(name).alias("name"), _s(version).alias("version"),
        _s(description).alias("description"), _s(license_).alias("license"), F.coalesce("npm.private", F.lit(False)).alias("private"),
        hint.alias("kind_hint"), F.coalesce(workspaces, M.empty_strings()).alias("workspaces"),
        F.coalesce(entry, M.empty_strings()).alias("entrypoints"),
        F.when(fmt == "gomod", module).when(fmt == "pom", xroot("groupId")).otherwise("").alias("module_path"), "deps")


def declared(manifest_rows: DataFrame, keys: Keys) -> DataFrame:
    """Dependency rows of the manifests, in declaration order."""
    d = manifest_rows.select(*keys, F.col("path").alias("declared_in"), "ecosystem", F.posexplode_outer("deps").alias("ord", "d")).where("d IS NOT NULL")
    return d.select(
        *keys, "declared_in", "ord", F.col("d.name").alias("name"), F.col("d.version").alias("version"), "ecosystem", F.col("d.scope").alias("scope"),
        F.col("d.direct").alias("direct"), purl(F.col("d.name"), F.col("d.version"), "ecosystem").alias("purl"))


def locked(files: DataFrame, keys: Keys) -> DataFrame:
    """Resolved versions of all lockfiles."""
    text, path = F.col("text"), F.col("path")
    src = files.withColumn("format", lock_format("path")).where(F.col("format").isNotNull() & (text != "")).select(*keys, "path", "text", "format")
    fmt = F.col("format")
    dev = lambda v: F.when(F.get_json_object(v, "$.dev") == "true", "dev").otherwise("runtime")
    pkgs = F.from_json(F.get_json_object("text", "$.packages"), "map<string,string>")
    v2 = F.transform(F.filter(F.map_entries(pkgs), lambda e: (e["key"] != "") & F.get_json_object(e["value"], "$.version").isNotNull()), lambda e: _dep(
        F.substring_index(e["key"], "node_modules/", -1), F.get_json_object(e["value"], "$.version"), dev(e["value"]), False))
    is_v1 = (fmt == "npm_lock") & pkgs.isNull()
    yarn_blocks = F.split(text, r"(?m)(?=^[^\s#][^\n]*:[ \t]*$)")
    yarn_name = lambda b: F.regexp_extract(b, r"\A\"?(@?[^@\"\s,]+)", 1)
    yarn_version = lambda b: F.regexp_extract(b, r"(?m)^\s+version:?\s+\"?([^\"\s]+)", 1)
    yarn = F.transform(F.filter(yarn_blocks, lambda b: b.rlike(r"\A[^\s#]") & (yarn_version(b) != "")), lambda b: _dep(yarn_name(b), yarn_version(b), "runtime", False))
    pnpm_p = r"(?m)^\s{2}/?((?:@[\w.\-]+/)?[\w.\-]+)[@/](\d[\w.\-+]*)\s*:"
    pnpm = F.transform(_all(text, pnpm_p, 0), lambda m: _dep(_one(m, pnpm_p, 1), _one(m, pnpm_p, 2), "runtime", False))
    packages = F.filter(M.toml_sections(text), lambda s: s["header"] == "package")
    toml = F.transform(F.filter(packages, lambda s: M.toml_value(s["body"], "name") != ""), lambda s: _dep(
        M.toml_value(s["body"], "name"), M.toml_value(s["body"], "version"),
        F.when(M.toml_value(s["body"], "category") == "dev", "dev").otherwise("runtime"), False))
    specs = F.flatten(F.transform(F.filter(F.split(text, r"(?m)(?=^\S)"), lambda b: b.rlike(r"(?m)^\s*specs:\s*$")),
                                  lambda b: _all(b, r"(?m)^ {4}[\w.\-]+ \([^)]+\)", 0)))
    gem = F.transform(specs, lambda l: _dep(_one(l, r"^\s+(\S+)"), _one(l, r"\(([^)]+)\)"), "runtime", False))
    php = lambda key, scope: F.transform(F.from_json(F.get_json_object("text", f"$['{key}']"), "array<struct<name:string,version:string>>"), lambda p: _dep(p["name"], p["version"], scope, False))
    # The first version listed for a module wins.
    sums = F.transform(_all(text, r"(?m)^(\S+\s+v\S+)", 1), lambda l: F.struct(
        _one(l, r"^(\S+)").alias("n"), F.replace(_one(l, r"\s(v\S+)"), F.lit("/go.mod"), F.lit("")).alias("v")))
    # Later duplicates fall away: a module line counts if the line before names another module.
    gosum = F.transform(sums, lambda s: _dep(s["n"], s["v"], "runtime", False))
    nuget = F.flatten(F.transform(F.map_values(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,map<string,struct<resolved:string,type:string>>>")), lambda m: F.transform(
        F.filter(F.map_entries(m), lambda e: F.coalesce(e["value"]["resolved"], F.lit("")) != ""),
        lambda e: _dep(e["key"], e["value"]["resolved"], "runtime", F.coalesce(e["value"]["type"] == "Direct", F.lit(False))))))
    pub = F.transform(M.yaml_blocks(M.yaml_inner(M.yaml_child(M.yaml_blocks(M.yaml_even(text), 0), "packages")), 1), lambda b: _dep(
        M.yaml_key(b), M.unquote(_one(M.yaml_inner(b), r"(?m)^\s*version:[ \t]*([^\n]*)")), "runtime", False))
    deps = (
        F.when(fmt == "npm_lock", v2).when(fmt == "yarn", yarn).when(fmt == "pnpm", pnpm)
        .when(fmt.isin("poetry", "cargo_lock"), toml).when(fmt == "gem_lock", gem)
        .when(fmt == "composer_lock", _concat(php("packages", "runtime"), php("packages-dev", "dev")))
        .when(fmt == "gosum", gosum).when(fmt == "nuget_lock", nuget).when(fmt == "pub_lock", pub))
    listed = src.where(~F.coalesce(is_v1, F.lit(False))).select(*keys, "path", "format", F.posexplode(deps).alias("ord", "d"))
    nested = _nested_npm(src.where(is_v1), keys).select(*keys, "path", "format", F.posexplode("deps").alias("ord", "d"))
    rows = listed.unionByName(nested).select(
        *keys, F.col("path").alias("declared_in"), "format", "ord", "d.*", _lookup(ECOSYSTEM, fmt).alias("ecosystem"))
    first_sum = rows.where("format = 'gosum'").groupBy(*keys, "declared_in", "format", "name", "scope", "direct", "ecosystem").agg(
        F.min("ord").alias("ord"), F.min_by("version", "ord").alias("version")).select(*rows.columns)
    out = rows.where("format <> 'gosum'").unionByName(first_sum)
    return out.where("name <> ''").select(
        *keys, "declared_in", "ord", "name", "version", "ecosystem", "scope", "direct",
        F.when(F.col("version") != "", purl("name", "version", "ecosystem")).otherwise("").alias("purl"))


def extra_dependencies(files: DataFrame, keys: Keys, formats: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Dependency rows of formats that the caller brings, in the columns of ``declared`` and ``locked``.

    ``formats`` maps a file name (any case) to its ecosystem and to a function from the text column to
    ``array<struct<name, version, scope, direct>>``. Each format reads only its own files.
    """
    out = None
    for name, (ecosystem, parse) in formats.items():
        src = files.where((F.lower(basename("path")) == name.lower()) & (F.col("text") != "")).select(*keys, "path", parse(F.col("text")).cast(f"array<{DEP}>").alias("deps"))
        rows = src.select(*keys, F.col("path").alias("declared_in"), F.posexplode_outer("deps").alias("ord", "d")).where("d IS NOT NULL").select(
            *keys, "declared_in", "ord", F.col("d.name").alias("name"), F.col("d.version").alias("version"), F.lit(ecosystem).alias("ecosystem"), F.col("d.scope").alias("scope"),
            F.col("d.direct").alias("direct"), purl(F.col("d.name"), F.col("d.version"), F.lit(ecosystem)).alias("purl"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _nested_npm(locks: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, path, format, deps)`` of version-1 lockfiles, whose dependencies nest to any depth.

    Every round takes the level that is open and opens the next; only the subtrees below are kept, so the text is read
    once and the rounds follow the depth of the data.
    """
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    entries = lambda js: F.coalesce(F.map_entries(F.from_json(js, "map<string,string>")), none)
    get = F.get_json_object
    now = cut(locks.select(*keys, "path", "format", F.expr(NO_DEPS).alias("deps"), entries(get("text", "$.dependencies")).alias("level")))
    while not now.where(F.size("level") > 0).isEmpty():
        found = F.transform(F.filter("level", lambda e: get(e["value"], "$.version").isNotNull()), lambda e: _dep(
            e["key"], get(e["value"], "$.version"), F.when(get(e["value"], "$.dev") == "true", "dev").otherwise("runtime"), False))
        below = F.flatten(F.transform("level", lambda e: entries(get(e["value"], "$.dependencies"))))
        now = cut(now.select(*keys, "path", "format", F.concat("deps", found).alias("deps"), below.alias("level")))
    return now.drop("level")


def ts_aliases(files: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, path, ord, prefix, target)`` of tsconfig / jsconfig path mappings."""
    from codecensus.functions.text import normal_path

    opts = files.where(F.lower(basename("path")).isin("tsconfig.json", "jsconfig.json")).select(
        *keys, "path", _json("compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>", F.regexp_replace("text", r"(?m)^\s*//[^\n]*$", ""))["compilerOptions"].alias("o"))
    base = F.concat_ws("/", F.nullif(dirname("path"), F.lit("")), F.coalesce("o.baseUrl", F.lit(".")))
    based = opts.select(*keys, "path", normal_path(F.concat(base, F.lit("/."))).alias("base"), F.map_entries("o.paths").alias("p"))
    default = F.when((F.col("base") != ""), F.array(*[F.struct(F.lit(p).alias("key"), F.array(F.lit("")).alias("value")) for p in ("~/", "@/")]))
    rows = based.select(*keys, "path", "base", F.posexplode(F.coalesce("p", default)).alias("ord", "e")).where(F.size("e.value") > 0)
    target = F.rtrim(F.replace(F.get("e.value", 0), F.lit("*"), F.lit("")), F.lit("/"))
    return rows.select(
        *keys, "path", "ord", F.replace(F.col("e.key"), F.lit("*"), F.lit("")).alias("prefix"),
        normal_path(F.concat_ws("/", F.nullif(F.col("base"), F.lit("")), target, F.lit("."))).alias("target"))


