"""Import resolution as one equi-join.

Every import becomes a question ``(repo, language, site, module, relative)``; equal
questions are asked once, however many files import the same module. Each question lists
candidate keys in order of preference; an index table maps keys to files. One join and
one ``min_by`` answer all languages.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions.packages import normal_name
from codecensus.functions.text import ancestors, basename, dirname, normal_path
from codecensus.session import shuffled

Keys = list[str]

# Fixed values.
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".vue", ".svelte", ".json")
JS_LANGUAGES = ("JavaScript", "TypeScript", "Vue", "Svelte")
JVM_LANGUAGES = ("Java", "Kotlin", "Scala", "Groovy")
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram",
    "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os",
    "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys",
    "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib", "test",
)
JVM_STDLIB = ("java.", "javax.", "jakarta.annotation", "kotlin.", "kotlinx.coroutines", "scala.", "sun.", "jdk.", "android.")
DOTNET_STDLIB = ("System", "Microsoft.Extensions", "Microsoft.Win32", "Windows.")
NPM_ENTRIES = ("src/index.ts", "src/index.js", "index.ts", "index.js", "src/main.ts", "src/index.tsx", "lib/index.js")
PATHLIKE = {
    "Ruby": (".rb",), "PHP": (".php",), "Shell": (".sh", ""), "C": (".h", ".c"), "C++": (".h", ".hpp", ".cpp"),
    "Elixir": (".ex",), "Dart": (".dart",), "Swift": (".swift",), "Protobuf": (".proto",),
}
PY_STDLIB = tuple(sorted(set(sys.stdlib_module_names) | {"typing_extensions", "dataclasses", "__future__"}))
NPM_NAME = r"^(@[^/]+/[^/]+|[^/@][^/]*)"

CAND = "array<struct<prio:int,space:string,key:string>>"


def _join(base: Column, tail: Column) -> Column:
    return F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(tail, F.lit("")))


def _prefixes(parts: Column) -> Column:
    """Every leading run of the parts, longest first."""
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(parts, F.lit(1), n - i))


def _cands(keys: Column, space: str, start: int = 0) -> Column:
    return F.transform(keys, lambda k, i: F.struct((i + start).cast("int").alias("prio"), F.lit(space).alias("space"), k.alias("key")))


def file_index(files: DataFrame, manifests: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, space, key, target, n)``: smallest path per key and how many paths share it."""
    segs = F.split("path", "/")
    lang, path = F.col("language"), F.col("path")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    mod_parts = F.split(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/")
    py_keys = F.when(stem != "__init__", F.transform(F.sequence(F.lit(1), F.size(mod_parts)), lambda i: F.array_join(
        F.slice(mod_parts, i, F.size(mod_parts)), ".")))
    name = F.regexp_replace(basename("path"), r"\.[^.]*$", "")
    # The package starts below the first directory named after the source set.
    marker = F.coalesce(*[F.nullif(F.array_position(segs, m), F.lit(0)) for m in ("java", "kotlin", "scala", "groovy")])
    pkg_segs = F.slice(segs, (marker + 1).cast("int"), F.greatest(F.size(segs) - marker - 1, F.lit(0)).cast("int"))
    pkg = F.when(marker.isNotNull(), F.array_join(pkg_segs, "."))
    jvm = F.when(marker.isNull(), F.array(name)).when(pkg != "", F.array(F.concat(pkg, F.lit("."), name), F.concat(pkg, F.lit(".*")))).otherwise(F.array())
    jvm_prefixes = F.when(pkg != "", F.transform(_prefixes(pkg_segs), lambda p: F.array_join(p, ".")))
    empty = F.expr("cast(array() as array<struct<space:string,key:string>>)")

    def entries(space: str, arr: Column) -> Column:
        return F.coalesce(F.transform(arr, lambda k: F.struct(F.lit(space).alias("space"), k.alias("key"))), empty)

    all_keys = F.concat(
        entries("path", F.array(path)),
        entries("py", F.when(lang == "Python", py_keys)),
        entries("jvm", F.when(lang.isin(*JVM_LANGUAGES), jvm)),
        entries("jvmp", F.when(lang.isin(*JVM_LANGUAGES), jvm_prefixes)),
        entries("net", F.when(lang == "C#", F.array(name))),
        entries("godir", F.when(lang == "Go", F.array(dirname("path")))),
    )
    base = files.select(*keys, "path", F.explode(all_keys).alias("k")).select(*keys, F.col("k.space").alias("space"), F.col("k.key").alias("key"), "path")
    plain = base.where("key <> ''").groupBy(*keys, "space", "key").agg(F.min("path").alias("target"), F.count(F.lit(1)).alias("n"))
    return plain.unionByName(_npm_index(files, manifests, keys)).unionByName(_crate_index(files, manifests, keys))


def tail_index(files: DataFrame, asked: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, space, key, target, n)`` of path suffixes that questions ask for, from ``asked(keys, key)``.

    Only files with a name that is asked for are spelled out, in as many suffixes as are asked for of that name, by
    their numbers of segments; one join with the asked suffixes then leaves those that occur.
    """
    want = asked.select(*keys, "key").distinct().withColumn("name", basename("key")).withColumn("long", F.size(F.split("key", "/")))
    names = want.groupBy(*keys, "name").agg(F.collect_set("long").alias("longs"))  # at most as many as paths are deep
    segs = F.split("path", "/")
    spelled = files.select(*keys, "path", basename("path").alias("name")).join(shuffled(names), [*keys, "name"]).select(
        *keys, "path", F.explode(F.filter("longs", lambda n: n < F.size(segs))).alias("n")).select(
        *keys, "path", F.array_join(F.slice(segs, F.size(segs) - F.col("n") + 1, F.col("n")), "/").alias("key"))
    return spelled.groupBy(*keys, "key").agg(F.min("path").alias("target"), F.count(F.lit(1)).alias("n")).join(
        shuffled(want.select(*keys, "key")), [*keys, "key"], "left_semi").select(*keys, F.lit("tail").alias("space"), "key", "target", "n")


def _npm_index(files: DataFrame, manifests: DataFrame, keys: Keys) -> DataFrame:
    """Workspace package name -> its entry file."""
    pk = manifests.where("ecosystem = 'npm' AND name <> ''").groupBy(*keys, "name").agg(F.max_by("dir", "path").alias("dir"))
    listed = pk.select(*keys, "name", F.posexplode(F.array(*[_join(F.col("dir"), F.lit(e)) for e in NPM_ENTRIES])).alias("prio", "path"))
    exact = listed.join(shuffled(files.select(*keys, "path")), [*keys, "path"]).select(*keys, "name", "prio", "path")
    inside = (
        files.where(F.col("path").rlike(r"\.(ts|js|tsx)$")).select(*keys, "path", F.explode(ancestors("path")).alias("dir"))
        .join(shuffled(pk), [*keys, "dir"]).groupBy(*keys, "name").agg(F.min("path").alias("path")).withColumn("prio", F.lit(99))
    )
    return exact.unionByName(inside.select(*exact.columns)).groupBy(*keys, F.col("name").alias("key")).agg(
        F.min_by("path", "prio").alias("target")).select(*keys, F.lit("npm").alias("space"), "key", "target", F.lit(1).cast("long").alias("n"))


def _crate_index(files: DataFrame, manifests: DataFrame, keys: Keys) -> DataFrame:
    """Crate name -> lib.rs or main.rs; directories seen in files come before manifests."""
    rs = files.where((F.col("language") == "Rust") & F.col("path").contains("/src/"))
    seen = rs.select(*keys, F.regexp_replace("path", r"/src/(?!.*/src/).*$", "").alias("dir"), F.col("path").alias("o")).select(
        *keys, F.replace(basename("dir"), F.lit("-"), F.lit("_")).alias("key"), "dir", F.concat(F.lit("0"), "o").alias("o"))
    named = manifests.where("ecosystem = 'cargo' AND name <> ''").select(
        *keys, F.replace("name", F.lit("-"), F.lit("_")).alias("key"), "dir", F.concat(F.lit("1"), "path").alias("o"))
    where = seen.unionByName(named).groupBy(*keys, "key").agg(F.min_by("dir", "o").alias("dir"))
    listed = where.select(*keys, "key", F.posexplode(F.array(*[_join(F.col("dir"), F.lit(f"src/{f}")) for f in ("lib.rs", "main.rs")])).alias("prio", "path"))
    return listed.join(shuffled(files.select(*keys, "path")), [*keys, "path"]).groupBy(*keys, "key").agg(F.min_by("path", "prio").alias("target")).select(
        *keys, F.lit("crate").alias("space"), "key", "target", F.lit(1).cast("long").alias("n"))


def _questions(imports: DataFrame, keys: Keys) -> DataFrame:
    lang = F.col("language")
    needs_site = (
        F.when(lang == "Python", F.col("module").startswith("."))
        .when(lang.isin(*JS_LANGUAGES), F.col("module").startswith("."))
        .when(lang == "Rust", F.lit(True)).when(lang.isin(*PATHLIKE), F.col("relative") | F.col("module").startswith(".")).otherwise(False)
    )
    return imports.withColumn("site", F.when(needs_site, dirname("file")).otherwise(""))


def _candidates(q: DataFrame) -> Column:
    m, lang, site = F.col("module"), F.col("language"), F.col("site")
    # Python: dots walk up from the importing directory; absolute names try shorter prefixes.
    dots = F.length(F.regexp_extract(m, r"^(\.+)", 1))
    up = F.split(site, "/")
    kept = F.when(site == "", F.array()).otherwise(F.slice(up, F.lit(1), F.greatest(F.size(up) - (dots - 1), F.lit(0))))
    tail = F.replace(F.ltrim(m, F.lit(".")), F.lit("."), F.lit("/"))
    stem = F.array_join(F.filter(F.concat(kept, F.array(tail)), lambda s: s != ""), "/")
    py_rel = _cands(F.array(*[F.concat(stem, F.lit(s)) for s in (".py", "/__init__.py", ".pyi")]), "path")
    py_abs = _cands(F.transform(_prefixes(F.split(m, r"\.")), lambda p: F.array_join(p, ".")), "py")

    def js_files(target: Column, start: int = 0) -> Column:
        probes = [""] + list(JS_EXTENSIONS) + [f"/index{e}" for e in JS_EXTENSIONS]
        return _cands(F.array(*[F.concat(target, F.lit(p)) for p in probes]), "path", start)

    js_rel = js_files(normal_path(_join(site, m)))
    npm = F.regexp_extract(m, NPM_NAME, 1)
    js_pkg = _cands(F.array(F.when(npm != "", npm).otherwise(m)), "npm", 1_000_000)
    jvm = F.concat(_cands(F.array(m), "jvm"), F.when(m.endswith(".*"), _cands(F.array(F.regexp_replace(m, r"\.\*$", "")), "jvmp", 1)).otherwise(F.expr(f"cast(array() as {CAND})")))
    net = _cands(F.array(F.substring_index(m, ".", -1)), "net")
    rust = F.concat(_cands(F.array(m), "crate"), _cands(F.array(_join(site, F.concat(m, F.lit(".rs"))), _join(site, F.concat(m, F.lit("/mod.rs")))), "path", 1))
    clean = F.btrim(m, F.lit("./"))
    near = F.col("relative") | m.startswith(".")
    listed = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    exts = F.try_element_at(listed(PATHLIKE), lang)
    tails = F.try_element_at(listed({k: tuple(dict.fromkeys(("", *v))) for k, v in PATHLIKE.items()}), lang)

    def spelled(base: Column, at: int) -> Column:
        return F.concat(
            F.transform(exts, lambda e, i: F.struct((i + at).cast("int").alias("prio"), F.lit("path").alias("space"), F.concat(base, e).alias("key"))),
            # All spellings of a suffix share one rank: it counts only when one single file has any of them.
            F.transform(tails, lambda e: F.struct(F.lit(at + 9).alias("prio"), F.lit("tail").alias("space"), F.concat(base, e).alias("key"))))

    paths = F.when(exts.isNotNull(), F.when(near, F.concat(spelled(normal_path(_join(site, m)), 0), spelled(clean, 10))).otherwise(spelled(clean, 10)))
    return (
        F.when((lang == "Python") & m.startswith("."), py_rel).when(lang == "Python", py_abs)
        .when(lang.isin(*JS_LANGUAGES) & m.startswith("."), js_rel).when(lang.isin(*JS_LANGUAGES), js_pkg)
        .when(lang.isin(*JVM_LANGUAGES), jvm).when(lang == "C#", net).when((lang == "Rust") & ~m.isin("crate", "self", "super", "std", "core", "alloc"), rust)
        .otherwise(paths)
    )


def resolve(imports: DataFrame, files: DataFrame, manifests: DataFrame, aliases: DataFrame, keys: Keys) -> DataFrame:
    """Imports with ``internal_file, external_package, ecosystem, unresolved, stdlib``.

    ``imports(keys, file, language, module, line, raw, relative)``, ``files(keys, path,
    language)``, ``manifests(keys, path, dir, ecosystem, name, module_path)``,
    ``aliases(keys, path, ord, prefix, target)``.
    """
    asked = _questions(imports, keys)
    by = [*keys, "language", "site", "module", "relative"]
    q = asked.select(*by).distinct()
    index = file_index(files, manifests, keys)
    listed = q.select(*by, F.explode(_candidates(q)).alias("c")).select(*by, F.col("c.prio").alias("prio"), F.col("c.space").alias("space"), F.col("c.key").alias("key"))
    listed = listed.unionByName(_alias_candidates(q, aliases, keys, by)).unionByName(_go_candidates(q, manifests, keys, by))
    tails = tail_index(files, listed.where("space = 'tail'"), keys)
    hits = listed.join(shuffled(index.unionByName(tails)), [*keys, "space", "key"])
    single = hits.where("space <> 'tail'").select(*by, "prio", "target")
    unique = hits.where("space = 'tail'").groupBy(*by, "prio").agg(F.min("target").alias("target"), F.sum("n").alias("n")).where("n = 1")
    answer = single.unionByName(unique.select(*by, "prio", "target")).groupBy(*by).agg(F.min_by("target", "prio").alias("internal_file"))
    in_module = _go_modules(q, manifests, keys, by).select(*by, F.lit(True).alias("in_module")).distinct()
    solved = q.join(shuffled(answer), by, "left").join(shuffled(in_module), by, "left")
    hit = F.col("internal_file").isNotNull()
    m, lang = F.col("module"), F.col("language")
    npm = F.when(F.regexp_extract(m, NPM_NAME, 1) != "", F.regexp_extract(m, NPM_NAME, 1)).otherwise(m)
    starts = lambda prefixes: m.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")
    three = lambda sep: F.substring_index(m, sep, 3)
    js = lang.isin(*JS_LANGUAGES)
    stdlib = ~hit & (
        ((lang == "Python") & ~m.startswith(".") & F.substring_index(m, ".", 1).isin(*PY_STDLIB))
        | (js & ~m.startswith(".") & (m.startswith("node:") | npm.isin(*NODE_BUILTINS)))
        | ((lang == "Go") & F.col("in_module").isNull() & ~F.substring_index(m, "/", 1).contains("."))
        | (lang.isin(*JVM_LANGUAGES) & starts(JVM_STDLIB)) | ((lang == "C#") & starts(DOTNET_STDLIB))
        | ((lang == "Rust") & m.isin("std", "core", "alloc")))
    package = (
        F.when(hit | stdlib, "").when((lang == "Python") & ~m.startswith("."), F.substring_index(m, ".", 1))
        .when(js & ~m.startswith(".") & ~m.rlike("^(https?://|/)"), npm)
        .when((lang == "Go") & F.col("in_module").isNull(), three("/"))
        .when(lang.isin(*JVM_LANGUAGES), three(".")).when(lang == "C#", m)
        .when((lang == "Rust") & ~m.isin("crate", "self", "super"), m)
        .when(lang == "Ruby", F.substring_index(m, "/", 1)).when(lang == "PHP", F.substring_index(m, "/", 2))
        .when(lang == "Dart", F.substring_index(F.replace(m, F.lit("package:"), F.lit("")), "/", 1)).otherwise(""))
    eco = (
        F.when(lang == "Python", "pypi").when(js, "npm").when(lang == "Go", "go").when(lang.isin(*JVM_LANGUAGES), "maven")
        .when(lang == "C#", "nuget").when(lang == "Rust", "cargo").when(lang == "Ruby", "rubygems").when(lang == "PHP", "composer").when(lang == "Dart", "pub").otherwise(""))
    solved = solved.withColumn("external_package", package).withColumn("stdlib", stdlib)
    solved = solved.select(
        *by, F.coalesce("internal_file", F.lit("")).alias("internal_file"), "external_package",
        F.when(F.col("external_package") != "", eco).otherwise("").alias("ecosystem"), "stdlib",
        (~hit & ~F.col("stdlib") & (F.col("external_package") == "")).alias("unresolved"))
    return asked.join(shuffled(solved), by).drop("site")


def _alias_candidates(q: DataFrame, aliases: DataFrame, keys: Keys, by: list[str]) -> DataFrame:
    """Path aliases: the longest matching prefix first.

    A module is cut only to the lengths that prefixes of its repository have, so this is an equi-join on few rows.
    """
    m = F.col("module")
    known = aliases.where("prefix <> ''").select(*keys, "prefix", "path", "ord", F.col("target").alias("to")).distinct()
    lengths = known.groupBy(*keys).agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))  # a number for each length
    js = q.where(F.col("language").isin(*JS_LANGUAGES) & ~m.startswith("."))
    js = js.join(shuffled(lengths), keys) if keys else js.withColumn("lengths", lengths.select("lengths").scalar())
    pre = js.select(*by, F.explode(F.filter("lengths", lambda n: n <= F.length(m))).alias("n")).select(*by, F.left(m, F.col("n")).alias("prefix"))
    met = pre.join(shuffled(known), [*keys, "prefix"])
    first = met.groupBy(*by, "prefix").agg(F.collect_set("to").alias("tos"))
    target = normal_path(_join(F.col("to"), F.expr("substring(module, length(prefix) + 1)")))
    probes = [""] + list(JS_EXTENSIONS) + [f"/index{e}" for e in JS_EXTENSIONS]
    return first.select(*by, "prefix", F.explode(F.array_sort("tos")).alias("to")).select(
        *by, F.length("prefix").alias("len"), F.posexplode(F.array(*[F.concat(target, F.lit(p)) for p in probes])).alias("probe", "key")
    ).select(*by, ((1000 - F.least(F.col("len"), F.lit(999))) * 100 + F.col("probe")).cast("int").alias("prio"), F.lit("path").alias("space"), "key")


def _go_modules(q: DataFrame, manifests: DataFrame, keys: Keys, by: list[str]) -> DataFrame:
    """Go imports inside a module of the repository, with the longest module path."""
    go = q.where("language = 'Go'")
    pre = go.select(*by, F.explode(F.transform(_prefixes(F.split("module", "/")), lambda p: F.array_join(p, "/"))).alias("mod"))
    mods = manifests.where("ecosystem = 'go' AND module_path <> ''").groupBy(*keys, F.col("module_path").alias("mod")).agg(F.min_by("dir", "path").alias("dir"))
    return pre.join(shuffled(mods), [*keys, "mod"]).groupBy(*by).agg(F.max_by(F.struct("mod", "dir"), F.length("mod")).alias("best")).select(*by, "best.mod", "best.dir")


def _go_candidates(q: DataFrame, manifests: DataFrame, keys: Keys, by: list[str]) -> DataFrame:
    sub = F.btrim(F.expr("substring(module, length(mod) + 1)"), F.lit("/"))
    return _go_modules(q, manifests, keys, by).select(
        *by, F.lit(0).alias("prio"), F.lit("godir").alias("space"), _join(F.col("dir"), sub).alias("key"))


def file_edges(resolved: DataFrame, keys: Keys) -> DataFrame:
    """Import edges between files, one per pair, weighted by the number of imports."""
    return resolved.where("internal_file <> ''").groupBy(*keys, F.col("file").alias("source"), F.col("internal_file").alias("target")).agg(
        F.count(F.lit(1)).alias("weight"), F.min("line").alias("line")).withColumn("kind", F.lit("imports"))


def external_usage(resolved: DataFrame, app_of_file: DataFrame, keys: Keys, max_files: int = 25) -> DataFrame:
    """Per (package, ecosystem): number of files, the first files, the apps."""
    from codecensus.operators.windows import capped_list

    used = resolved.where("external_package <> ''").select(
        *keys, normal_name("external_package", "ecosystem").alias("name"), "ecosystem", "file").distinct()
    by = [*keys, "name", "ecosystem"]
    apps = used.join(shuffled(app_of_file.select(*keys, F.col("path").alias("file"), "app")), [*keys, "file"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_set(F.nullif("app", F.lit("")))).alias("apps"))
    return apps.join(shuffled(capped_list(used, by, ["file"], F.col("file"), max_files, "files")), by)


def unresolved_counts(resolved: DataFrame, keys: Keys) -> DataFrame:
    return resolved.groupBy(*keys).agg(F.count_if("unresolved").alias("unresolved_imports"))
