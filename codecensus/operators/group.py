"""Applications and components: where roots are, which file belongs where, what an app is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions.classify import is_code
from codecensus.functions.text import ancestors, basename, dirname, glob_regex_col, identifier_tokens, singular, slug, title_case
from codecensus.operators.windows import capped_list, top_per_group
from codecensus.session import cut

Keys = list[str]

# Fixed values.
CONTAINERS = ("apps", "packages", "services", "projects", "modules", "libs", "components", "functions", "workers", "cmd", "microservices", "src/apps")
AGGREGATORS = ("pnpm-workspace.yaml", "lerna.json", "go.work")
KIND_HINTS = (
    (r"(?i)(^|/)(web|frontend|ui|client|www|site|portal|dashboard)($|/)", "frontend"),
    (r"(?i)(^|/)(api|service|svc|server|backend|gateway)($|/)", "service"),
    (r"(?i)(^|/)(cli|cmd|tools?|scripts?)($|/)", "cli"),
    (r"(?i)(^|/)(worker|jobs?|cron|consumer|scheduler|batch)($|/)", "job"),
    (r"(?i)(^|/)(lib|libs|packages?|shared|common|core|sdk)($|/)", "library"),
    (r"(?i)(^|/)(infra|infrastructure|deploy|terraform|k8s|charts?|ops)($|/)", "infra"),
    (r"(?i)(^|/)(docs?|documentation|website)($|/)", "docs"),
)
WEB_FRAMEWORKS = (
    "FastAPI", "Flask", "Django", "Starlette", "aiohttp", "Sanic", "Tornado", "Express", "NestJS", "Fastify", "Koa", "Hapi",
    "Spring", "Spring Boot", "JAX-RS", "Micronaut", "Quarkus", "Ktor", "ASP.NET Core", "ASP.NET Minimal API", "Gin", "Echo",
    "Chi", "Fiber", "Actix", "Axum", "Rocket", "Ruby on Rails", "Sinatra", "Laravel", "Symfony", "Phoenix",
)
FRONTEND_FRAMEWORKS = ("React", "Vue", "Angular", "Svelte", "Next.js", "Nuxt", "SwiftUI", "Flutter")
JOB_FRAMEWORKS = ("Celery", "Sidekiq", "BullMQ", "Airflow", "Temporal")
STYLE_SIGNALS = {
    "Layered (controller / service / repository)": (
        ("controller", "controllers", "handler", "handlers"), ("service", "services", "usecase", "usecases"),
        ("repository", "repositories", "dao", "store", "stores")),
    "Hexagonal / Ports & Adapters": (("domain",), ("application", "app"), ("adapters", "adapter", "ports", "infrastructure")),
    "Clean architecture": (("entities", "domain"), ("usecases", "use_cases", "interactors"), ("interfaces", "gateways", "adapters")),
    "MVC": (("models", "model"), ("views", "view", "templates"), ("controllers", "controller")),
    "CQRS": (("commands", "command"), ("queries", "query")),
    "Feature-sliced / modular": (("features", "modules"),),
    "Event-driven": (("events", "consumers", "producers", "subscribers", "listeners"),),
}
STOP_SEGMENTS = (
    "api", "apis", "v1", "v2", "v3", "graphql", "rest", "rpc", "health", "healthz", "ready", "readyz", "live", "livez", "metrics",
    "status", "ping", "docs", "swagger", "openapi", "static", "assets", "public", "index", "root", "web", "app", "internal",
    "admin", "auth", "callback", "webhook", "webhooks", "_next", "favicon.ico",
)
GENERIC_TYPES = (
    "config", "settings", "base", "main", "app", "application", "client", "server", "handler", "handlers", "service", "services",
    "repository", "manager", "helper", "helpers", "utils", "util", "error", "errors", "exception", "test", "tests", "mock",
    "factory", "builder", "request", "response", "options", "result", "context", "logger", "middleware", "router",
)
TYPE_SUFFIXES = ("Controller", "Service", "Repository", "Handler", "Model", "Entity", "Dto", "DTO", "Schema", "Resource", "Manager")
NOUN_KINDS = ("class", "struct", "record", "table", "message", "interface", "entity")


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _strings() -> Column:
    return F.expr("cast(array() as array<string>)")


# ---------------------------------------------------------------- prefixes

def deepest_prefix(paths: DataFrame, roots: DataFrame, keys: Keys, path: str = "path", root: str = "root") -> DataFrame:
    """``(keys, path, root)``: the deepest root that contains each path, '' included if it is a root.

    Ancestors are exploded, so containment is an equi-join; paths of one directory share
    their answer and are looked up once.
    """
    dirs = paths.select(*keys, dirname(path).alias("__dir")).distinct()
    above = dirs.select(*keys, "__dir", F.explode(ancestors(F.concat(F.col("__dir"), F.when(F.col("__dir") == "", "x").otherwise("/x")))).alias(root))
    best = above.join(roots.select(*keys, root).distinct(), [*keys, root]).groupBy(*keys, "__dir").agg(F.max_by(root, F.length(root)).alias(root))
    return paths.withColumn("__dir", dirname(path)).join(best, [*keys, "__dir"], "left").drop("__dir")


def workspace_members(manifests: DataFrame, dirs: DataFrame, keys: Keys) -> DataFrame:
    """Directories named by workspace patterns, ``*`` matching one directory level."""
    pat = F.btrim(F.btrim("w"), F.lit("./"))
    raw = manifests.select(*keys, "dir", F.explode("workspaces").alias("w")).withColumn("p", pat).where("p <> ''")
    full = F.replace(F.concat_ws("/", F.nullif("dir", F.lit("")), "p"), F.lit("/**"), F.lit("/*"))
    full = F.when(~full.contains("*") & full.rlike(r"(pom\.xml|package\.json|build\.gradle)$"), dirname(full)).otherwise(full)
    asked = raw.select(*keys, full.alias("full")).distinct()
    # The literal directory in front of the first star is the join key.
    fixed = F.when(F.col("full").contains("*"), dirname(F.substring_index("full", "*", 1))).otherwise(F.col("full"))
    asked = asked.withColumn("at", fixed)
    here = dirs.select(*keys, F.col("dir").alias("root"), F.explode(ancestors(F.concat("dir", F.lit("/x")))).alias("at"))
    met = here.join(asked, [*keys, "at"])
    star = F.col("full").contains("*")
    hit = F.when(star, F.rlike("root", glob_regex_col("full")) & ~F.rlike("root", glob_regex_col(F.concat("full", F.lit("/*"))))).otherwise(F.col("root") == F.col("full"))
    return met.where(hit).select(*keys, "root").distinct()


def app_roots(files: DataFrame, manifests: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, root, manifest)`` after pruning; ``manifest`` is a path or ''."""
    dirs = files.where(F.col("path").contains("/")).select(*keys, dirname("path").alias("dir")).distinct()
    members = workspace_members(manifests, dirs, keys).select(*keys, "root", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("m"))
    named = manifests.where(
        ~((F.size("workspaces") > 0) & (F.size("deps") == 0)) & ~F.lower(basename("path")).isin(*AGGREGATORS)
    ).select(*keys, F.col("dir").alias("root"), F.lit(1).alias("rank"), F.col("path").alias("m"))
    with_code = files.where("kind = 'source'").select(*keys, F.explode(ancestors("path")).alias("root")).distinct()
    usual = dirs.where(dirname("dir").isin(*CONTAINERS)).select(*keys, F.col("dir").alias("root")).join(with_code, [*keys, "root"], "left_semi").select(
        *keys, "root", F.lit(2).alias("rank"), F.lit(None).cast("string").alias("m"))
    found = members.unionByName(named).unionByName(usual).groupBy(*keys, "root").agg(F.min(F.struct("rank", "m")).alias("first"))
    last = manifests.groupBy(*keys, F.col("dir").alias("root")).agg(F.max("path").alias("any"))
    roots = found.join(last, [*keys, "root"], "left").select(*keys, "root", F.coalesce("first.m", "any", F.lit("")).alias("manifest"))
    bare = files.select(*keys).distinct().join(roots.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("").alias("root"), F.lit("").alias("manifest"))
    roots = cut(roots.unionByName(bare))
    # Prune containers of other roots, and empty roots without a manifest.
    own = deepest_prefix(files.where(F.col("kind").isin("source", "test")).select(*keys, "path"), roots, keys).groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("own"))
    inner = roots.where("root <> ''").select(*keys, F.explode(ancestors("root")).alias("root")).distinct().withColumn("has_children", F.lit(True))
    judged = roots.join(own, [*keys, "root"], "left").join(inner, [*keys, "root"], "left").join(with_code.withColumn("has_code", F.lit(True)), [*keys, "root"], "left")
    n, kids, code = F.coalesce("own", F.lit(0)), F.coalesce("has_children", F.lit(False)), F.coalesce("has_code", F.lit(False))
    dropped = (kids & (n < 3) & (F.col("root") != "")) | (kids & (n == 0) & (F.col("root") == "")) | (~kids & ~code & (F.col("manifest") == ""))
    kept = judged.where(~dropped).select(*keys, "root", "manifest")
    none = files.select(*keys).distinct().join(kept.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("").alias("root"), F.lit("").alias("manifest"))
    return kept.unionByName(none)


# -------------------------------------------------------------- components

def split_components(files: DataFrame, keys: Keys, max_components: int = 40) -> DataFrame:
    """``(keys, app, root, key, path, dir, n)``: directory groups small enough to read.

    ``files(keys, app, root, path)``. A roll-up over the ancestors of each directory gives every directory the files and
    the branches below it. Then one walk from the top takes the choice for each directory from these sums and from what
    was chosen for its parent: a directory is a group of its own if it is small, if nothing is below it, or if three
    branchings lie above it; all below it belong to it. Otherwise only its own files do. A level is one join of
    directories with their parents, so no group ever holds all directories of an app.
    """
    by = [*keys, "app"]
    inner = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    dirs = cut(files.select(*by, "root", dirname(inner).alias("dir")).groupBy(*by, "root", "dir").agg(F.count(F.lit(1)).alias("n")))
    segs = F.filter(F.split("dir", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(segs, F.lit(1), i), "/").alias("prefix")))
    sums = dirs.select(*by, "root", "n", F.explode(above).alias("a")).groupBy(*by, "root", "a.level", "a.prefix").agg(F.sum("n").alias("total"))
    placed = [*by, "root"]
    parent = F.when(F.col("level") > 0, F.when(F.col("level") == 1, "").otherwise(F.regexp_replace("prefix", "/[^/]*$", "")))
    tree = sums.withColumn("parent", parent)
    kids = tree.where("level > 0").groupBy(*placed, F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("kids"))
    tree = tree.join(kids, [*placed, "prefix"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    target = F.greatest(F.lit(6), F.least(F.lit(60), F.floor(F.sum("total") / 12)))
    tree = cut(tree.join(tree.where("level = 0").groupBy(*by).agg(target.alias("target")), by))

    def judged(df: DataFrame) -> DataFrame:
        """Where nothing above has ended the walk, whether this directory does."""
        small = (F.col("depth") >= 3) | ((F.col("total") <= F.col("target")) & ~((F.col("depth") == 0) & (F.col("total") > 12)))
        ends = F.col("ended") | small | (F.col("kids") == 0)
        return df.select(*placed, "level", "prefix", F.when(F.col("ended"), F.col("key")).otherwise(F.col("prefix")).alias("key"), ends.alias("ended"),
                         (F.col("depth") + F.when(F.col("kids") > 1, 1).otherwise(0)).alias("depth"))

    now = cut(judged(tree.where("level = 0").withColumns({"key": F.lit(""), "ended": F.lit(False), "depth": F.lit(0)})))
    chosen = now
    for level in range(1, (tree.agg(F.max("level")).first()[0] or 0) + 1):
        up = now.select(*placed, F.col("prefix").alias("parent"), "key", "ended", "depth")
        now = cut(judged(tree.where(F.col("level") == level).join(up, [*placed, "parent"])))
        chosen = chosen.unionByName(now)
    out = dirs.join(chosen.select(*placed, F.col("prefix").alias("dir"), "key"), [*placed, "dir"])
    return out.select(*by, "root", "key", F.concat_ws("/", F.nullif("root", F.lit("")), F.nullif("key", F.lit(""))).alias("path"), "dir", "n")


def components(files: DataFrame, apps: DataFrame, keys: Keys, max_components: int = 40) -> DataFrame:
    """Component rows with kind, languages and size; beyond the limit small ones merge."""
    by = [*keys, "app"]
    parts = split_components(files, keys, max_components)
    inner = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    member = files.withColumn("dir", dirname(inner)).drop("path").join(
        parts.select(*by, "dir", "key", F.col("path").alias("cpath")), [*by, "dir"])
    test = F.count_if(F.col("kind") == "test")
    infra = F.count_if(F.col("kind").isin("infra", "config", "build"))
    docs = F.count_if(F.col("kind") == "docs")
    n = F.count(F.lit(1))
    rows = member.groupBy(*by, "root", "key", "cpath").agg(
        n.alias("files"), F.sum("loc").alias("loc"),
        F.when(test == n, "test").when(infra == n, "infra").when(docs == n, "docs").otherwise("module").alias("kind"))
    langs = member.where(is_code("language")).groupBy(*by, "key", "language").agg(F.count(F.lit(1)).alias("c"))
    listed = capped_list(langs, [*by, "key"], [F.desc("c"), "language"], F.col("language"), 3, "languages")
    segs = F.filter(F.split("key", "/"), lambda s: s != "")
    named = rows.join(listed, [*by, "key"], "left").join(apps.select(*keys, F.col("id").alias("app"), F.col("name").alias("app_name")), by)
    tail = F.array_join(F.slice(segs, F.greatest(F.size(segs) - 1, F.lit(1)), 2), "/")
    name = F.when(F.size(segs) > 0, tail).when(F.col("root") != "", basename("root")).otherwise(F.col("app_name"))
    full = named.select(
        *by, slug(F.lit("c"), F.when(F.col("cpath") != "", F.col("cpath")).otherwise(F.col("app"))).alias("id"), name.alias("name"), F.col("cpath").alias("path"), "kind",
        F.coalesce("languages", _strings()).alias("languages"), "files", "loc", F.lit("").alias("description"))
    counts = full.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.sum("files").alias("__files"), F.sum("loc").alias("__loc"))
    small = counts.where(F.col("__n") <= max_components)
    large = counts.where(F.col("__n") > max_components)
    whole = full.join(small.select(*by), by, "left_semi")
    kept = top_per_group(full.join(large.select(*by), by, "left_semi"), by, [F.desc("files"), "path"], max_components - 1)
    held = kept.groupBy(*by).agg(F.sum("files").alias("f"), F.sum("loc").alias("l"))
    other = large.join(held, by).select(
        *by, slug(F.lit("c"), "app", F.lit("other")).alias("id"), F.lit("(other)").alias("name"), F.lit("").alias("path"), F.lit("module").alias("kind"),
        _strings().alias("languages"), (F.col("__files") - F.col("f")).alias("files"), (F.col("__loc") - F.col("l")).alias("loc"),
        F.format_string("%d small directories together", F.col("__n") - max_components + 1).alias("description"))
    return whole.unionByName(kept).unionByName(other)


def component_of_file(files: DataFrame, comps: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, path, app, component)``: longest component path; else the one without a path; else the shortest."""
    by = [*keys, "app"]
    roots = comps.where("path <> ''").select(*by, F.col("path").alias("root"), F.col("id").alias("component"))
    hit = deepest_prefix(files.select(*by, "path"), roots, by).join(roots, [*by, "root"], "left")
    spare = comps.groupBy(*by).agg(F.min_by("id", F.struct(F.length("path"), "path")).alias("__spare"))
    return hit.join(spare, by, "left").select(*keys, "path", "app", F.coalesce("component", "__spare", F.lit("")).alias("component"))


def attach(rows: DataFrame, owners: DataFrame, keys: Keys, file: str = "file") -> DataFrame:
    """Add app and component of the row's file ('' when unknown)."""
    own = owners.select(*keys, F.col("path").alias(file), "app", "component")
    return rows.join(own, [*keys, file], "left").withColumn("app", F.coalesce("app", F.lit(""))).withColumn("component", F.coalesce("component", F.lit("")))


# --------------------------------------------------------------------- apps

def app_kind(path: Column, hint: Column, frameworks: Column, has_endpoints: Column, has_dockerfile: Column) -> Column:
    """Code evidence first, then the manifest's hint, then the path."""
    slashed = F.concat(F.lit("/"), path)
    out = (
        F.when(F.arrays_overlap(frameworks, _lits(FRONTEND_FRAMEWORKS)), "frontend")
        .when(has_endpoints & F.arrays_overlap(frameworks, _lits(WEB_FRAMEWORKS)), "service")
        .when(F.arrays_overlap(frameworks, _lits(JOB_FRAMEWORKS)) & ~has_endpoints, "job")
        .when(hint != "", hint)
    )
    for pattern, kind in KIND_HINTS:
        out = out.when(slashed.rlike(pattern), kind)
    return out.when(has_endpoints | has_dockerfile, "service").otherwise("application")


def architecture_style(dirs: Column, frameworks: Column, endpoint_kinds: Column | None = None) -> Column:
    """Up to two styles: those whose directory groups are (all but one) present, most hits first."""
    low = F.transform(dirs, lambda d: F.lower(d))
    scored = []
    for style, groups in STYLE_SIGNALS.items():
        hits = sum((F.arrays_overlap(low, _lits(g)).cast("int") for g in groups), F.lit(0))
        scored.append(F.when(hits >= max(1, len(groups) - 1), F.struct((-hits).alias("o"), F.lit(style).alias("s"))))
    # Equal hits are ordered by name, descending.
    ranked = F.array_sort(F.array_compact(F.array(*scored)), lambda a, b: F.when(
        a["o"] != b["o"], F.when(a["o"] < b["o"], -1).otherwise(1)).when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).otherwise(0))
    extra = [
        F.when(F.array_contains(low, "serverless") | F.array_contains(frameworks, "Serverless"), "Serverless / function-per-endpoint"),
        F.when(F.arrays_overlap(frameworks, _lits(("Django", "Ruby on Rails", "Laravel"))), "Framework MVC (batteries included)"),
    ]
    if endpoint_kinds is not None:
        extra.append(F.when(F.array_contains(F.transform(endpoint_kinds, lambda k: F.lower(k)), "graphql"), "GraphQL API"))
    styles = F.array_distinct(F.concat(F.transform(ranked, lambda r: r["s"]), F.array_compact(F.array(*extra))))
    return F.when(F.size(styles) == 0, "Unclassified (flat or ad-hoc layout)").otherwise(F.array_join(F.slice(styles, 1, 2), " + "))


def build_apps(files: DataFrame, roots: DataFrame, manifests: DataFrame, marks: DataFrame, endpoints: DataFrame, readmes: DataFrame, keys: Keys) -> DataFrame:
    """App rows. ``files`` carries ``root``; ``marks(keys, path, frameworks)``; ``readmes(keys, path, summary)``."""
    by = [*keys, "root"]
    f = files.select(*keys, "root", "path", "language", "loc")
    counts = f.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    langs = capped_list(
        f.where(is_code("language")).groupBy(*by, "language").agg(F.count(F.lit(1)).alias("c")), by, [F.desc("c"), "language"], F.col("language"), 1000, "languages")  # no more than the language table has
    used = f.join(marks, [*keys, "path"]).select(*by, F.explode("frameworks").alias("fw")).groupBy(*by, "fw").agg(F.count(F.lit(1)).alias("c"))
    fws = capped_list(used, by, [F.desc("c"), "fw"], F.col("fw"), 200, "all_frameworks")
    dir_names = f.select(*by, F.explode(F.filter(F.split(dirname("path"), "/"), lambda s: s != "")).alias("d")).distinct()
    # Only names that mean something for the style are kept, so the array stays short.
    wanted = {n for groups in STYLE_SIGNALS.values() for g in groups for n in g} | {"serverless"}
    dnames = dir_names.where(F.lower("d").isin(*sorted(wanted))).groupBy(*by).agg(F.collect_set("d").alias("dirs"))
    has_ep = f.join(endpoints.select(*keys, F.col("file").alias("path")).distinct(), [*keys, "path"], "left_semi").select(*by).distinct().withColumn("has_endpoints", F.lit(True))
    docker = F.lower(basename("path")).startswith("dockerfile") | F.lower(basename("path")).endswith(".dockerfile")
    has_df = files.where(docker).select(*keys, F.explode(ancestors("path")).alias("root")).distinct().withColumn("has_dockerfile", F.lit(True))
    man = manifests.select(*keys, F.col("path").alias("manifest"), F.col("name").alias("m_name"), "kind_hint", F.col("description").alias("m_desc"), F.col("entrypoints").alias("m_entry"))
    read = readmes.where(basename("path").isin("README.md", "readme.md")).groupBy(*keys, dirname("path").alias("root")).agg(F.min_by("summary", "path").alias("readme"), F.min("path").alias("readme_path"))
    base = counts.join(roots, by).join(langs, by, "left").join(fws, by, "left").join(dnames, by, "left").join(has_ep, by, "left").join(has_df, by, "left")
    base = base.join(man, [*keys, "manifest"], "left").join(read, by, "left")
    empty = _strings()
    frameworks = F.coalesce("all_frameworks", empty)
    own_name = F.when(F.coalesce("m_name", F.lit("")) != "", F.col("m_name")).when(F.col("root") != "", basename("root")).otherwise(F.col(keys[0]) if keys else F.lit("repository"))
    named = base.withColumn("raw_name", own_name)
    return named.select(
        *keys, slug(F.lit("app"), F.when(F.col("root") != "", F.col("root")).otherwise(F.col("raw_name"))).alias("id"),
        F.when(F.coalesce("m_name", F.lit("")) != "", F.col("raw_name")).otherwise(title_case("raw_name")).alias("name"), "root",
        app_kind(F.when(F.col("root") != "", F.col("root")).otherwise(F.col("raw_name")), F.coalesce("kind_hint", F.lit("")), frameworks,
                 F.coalesce("has_endpoints", F.lit(False)), F.coalesce("has_dockerfile", F.lit(False))).alias("kind"),
        F.coalesce("languages", empty).alias("languages"), frameworks.alias("frameworks"),
        F.when(F.col("manifest") != "", F.array("manifest")).otherwise(empty).alias("manifests"),
        F.filter(F.coalesce("m_entry", empty), lambda e: e != "").alias("entrypoints"), "files", "loc",
        F.coalesce(F.nullif("readme", F.lit("")), "m_desc", F.lit("")).alias("description"),
        architecture_style(F.coalesce("dirs", empty), frameworks).alias("architecture_style"))


def readme_summary(text: Column | str, max_chars: int = 400) -> Column:
    """First real paragraph of a README, without badges, headings and markup."""
    from codecensus.functions.text import ELLIPSIS, lines, strip

    def clean(l: Column) -> Column:
        bare = F.regexp_replace(l, r"<[^>]+>", " ")
        links = F.size(F.split(bare, r"\]\("))
        badge = strip(bare).startswith("![") | strip(bare).startswith("[!") | (bare.rlike(r"^[\[!\]\(\)\w\s/:.\-=?&+#]*$") & (links >= 3))
        shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")
        skip = l.rlike(r"^(#|>|---|===|\||<!--)") | (strip(bare) == "") | badge
        return F.when(skip, "").otherwise(strip(shown))

    # A blank line ends the paragraph once it has begun; skipped lines neither begin nor end it.
    state = F.aggregate(
        lines(text), F.struct(F.lit("").alias("out"), F.lit(False).alias("done")),
        lambda a, raw: F.when(a["done"], a).when(strip(raw) == "", F.struct(a["out"].alias("out"), (a["out"] != "").alias("done"))).otherwise(
            F.struct(F.concat_ws(" ", F.nullif(a["out"], F.lit("")), F.nullif(clean(strip(raw)), F.lit(""))).alias("out"),
                     (F.length(a["out"]) + F.length(clean(strip(raw))) > max_chars).alias("done"))),
        lambda a: a["out"])
    return F.when(F.length(state) > max_chars, F.concat(F.substring(state, 1, max_chars - 1), F.lit(ELLIPSIS))).otherwise(state)


# -------------------------------------------------------------------- nouns

def noun_weights(endpoints: DataFrame, symbols: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, noun, weight)``: 3 per route segment, 1 per handler part, 2 per type-name part."""
    segs = F.filter(F.split("path", "/"), lambda s: (s != "") & ~s.rlike(r"^[{:<*$]"))
    by_path = endpoints.select(*keys, F.explode(segs).alias("word"), F.lit(3).alias("w"))
    by_handler = endpoints.select(*keys, F.explode(F.split("handler", r"[._]|(?<=[a-z])(?=[A-Z])")).alias("word"), F.lit(1).alias("w"))
    name = F.substring_index("name", ".", -1)
    bare = F.regexp_replace(name, r"(?<=.)(?:" + "|".join(TYPE_SUFFIXES) + ")$", "")
    by_type = symbols.where(F.col("kind").isin(*NOUN_KINDS)).select(*keys, F.explode(F.split(bare, r"(?<=[a-z0-9])(?=[A-Z])|_")).alias("word"), F.lit(2).alias("w"))
    tokens = by_path.unionByName(by_handler).unionByName(by_type).select(*keys, "w", F.explode(identifier_tokens("word")).alias("token"))
    nouns = tokens.withColumn("noun", singular("token")).where(~F.col("noun").isin(*STOP_SEGMENTS) & ~F.col("noun").isin(*GENERIC_TYPES))
    return nouns.groupBy(*keys, "noun").agg(F.sum("w").alias("weight"))


def domain_nouns(endpoints: DataFrame, symbols: DataFrame, keys: Keys, limit: int = 6) -> DataFrame:
    """Top nouns per group, as ranked rows."""
    return top_per_group(noun_weights(endpoints, symbols, keys).where("weight > 1"), keys, [F.desc("weight"), "noun"], limit, rank="rank")
