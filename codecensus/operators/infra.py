"""Containers, orchestration, infrastructure code and pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions import formats as M
from codecensus.functions import yaml_rows as Y
from codecensus.functions.classify import image_system
from codecensus.functions.matching import bound, groups_sql, unmarked
from codecensus.functions.text import basename, slug
from codecensus.operators.windows import capped_list
from codecensus.session import once, shuffled

Keys = list[str]
# Top-level keys of pipeline files that are no jobs.
NOT_JOBS = ("stages", "variables", "image", "default", "include", "workflow", "trigger", "pool")


def infra_format(path: Column | str, kind: Column | str) -> Column:
    """Which extractor reads a file, NULL for none."""
    p = F.col(path) if isinstance(path, str) else path
    k = F.col(kind) if isinstance(kind, str) else kind
    name = F.lower(basename(p))
    fmt = (
        F.when(name.startswith("dockerfile") | name.endswith(".dockerfile"), "dockerfile")
        .when(name.rlike(r"^(docker-)?compose[.\w-]*\.ya?ml$"), "compose")
        .when(name.isin("serverless.yml", "serverless.yaml"), "serverless").when(p.endswith(".tf"), "terraform")
        .when(p.rlike(r"(^|/)\.github/workflows/.*\.ya?ml$"), "actions")
        .when(name.isin(".gitlab-ci.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml", "cloudbuild.yaml"), "pipeline")
        .when(name == "jenkinsfile", "jenkins").when(name == "chart.yaml", "helm").when(name.rlike(r"\.ya?ml$"), "kubernetes"))
    return F.when(k.isin("infra", "config", "build") | name.startswith("dockerfile"), fmt)


def _routed(files: DataFrame, keys: Keys, fmt: str) -> DataFrame:
    return files.where(infra_format("path", "kind") == fmt).select(*keys, F.col("path").alias("file"), "text")


def _all(pattern: str, group: int, text: str = "text") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def dockerfiles(files: DataFrame, keys: Keys) -> DataFrame:
    """Base images, stages, ports, user, entry point and environment of Dockerfiles."""
    stage = r"(?im)^\s*FROM\s+(\S+)(?:\s+AS\s+(\S+))?"
    env = r"(?im)^\s*ENV\s+([A-Z_][A-Z0-9_]*)[\s=]+(\S+)"
    last = lambda arr, default: F.coalesce(F.try_element_at(arr, F.lit(-1)), F.lit(default))
    pairs = F.arrays_zip(_all(env, 1).alias("k"), _all(env, 2).alias("v"))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return _routed(files, keys, "dockerfile").select(
        *keys, "file", _all(stage, 1).alias("base_images"), F.filter(_all(stage, 2), lambda s: s != "").alias("stages"),
        _all(r"(?im)^\s*EXPOSE\s+(\d+)", 1).cast("array<int>").alias("ports"),
        last(_all(r"(?im)^\s*USER\s+(\S+)", 1), "root (implicit)").alias("user"),
        F.btrim(last(_all(r"(?im)^\s*(?:ENTRYPOINT|CMD)\s+([^\n]+)$", 1), "")).alias("entrypoint"),
        F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])).alias("env"),
        (F.size(_all(stage, 1)) > 1).alias("multistage"))


def _outlined(files: DataFrame, keys: Keys, fmt: str) -> DataFrame:
    """``(keys, file, y)``: the rows of the first document of files of a format."""
    head = r"\A(?:[ \t]*(?:#[^\n]*)?\r?\n)*+---[ \t]*(?:#[^\n]*)?\r?\n"
    text = F.split(F.regexp_replace("text", head, ""), r"(?m)^---(?=[ \t\r]|$)", 2)[0]
    return _routed(files, keys, fmt).select(*keys, "file", once(Y.yaml_rows(text), "y"))


def _children(rows: Column) -> Column:
    """The keys at the top of ``under`` a path, in order, once each."""
    return F.array_distinct(F.transform(rows, lambda r: r["path"][0]))


def _named(rows: Column, name: Column) -> Column:
    """The rows below one of these keys."""
    return F.transform(F.filter(rows, lambda r: (F.size(r["path"]) > 1) & (r["path"][0] == name)),
                       lambda r: F.struct(F.slice(r["path"], F.lit(2), F.size(r["path"])).alias("path"), r["value"].alias("value"), r["line"].alias("line"), r["text"].alias("text")))


def containers(files: DataFrame, keys: Keys) -> DataFrame:
    """Services of compose files."""
    rows = _outlined(files, keys, "compose").select(*keys, "file", once(Y.under(F.col("y"), "services"), "s"))
    rows = rows.select(*keys, "file", "s", F.explode_outer(_children(F.col("s"))).alias("name")).select(*keys, "file", "name", once(_named(F.col("s"), F.col("name")), "y"))
    y = F.col("y")
    build = F.when(Y.value_at(y, "build") != "", Y.value_at(y, "build")).otherwise(Y.value_at(y, "build", "context"))
    return rows.where(F.size("y") > 0).select(
        *keys, "file", "name", Y.value_at(y, "image").alias("image"), build.alias("build"), Y.list_at(y, "ports").alias("ports"),
        F.transform(Y.list_at(y, "environment"), lambda e: F.substring_index(e, "=", 1)).alias("env_keys"), Y.list_at(y, "depends_on").alias("depends_on"), Y.list_at(y, "volumes").alias("volumes"))


def kubernetes(files: DataFrame, keys: Keys) -> DataFrame:
    """Objects of manifests that may hold several documents."""
    src = _routed(files, keys, "kubernetes").where(F.col("text").contains("apiVersion") & F.col("text").contains("kind:"))
    docs = src.select(*keys, "file", F.posexplode(Y.documents(F.col("text"))).alias("doc", "d")).select(*keys, "file", "doc", once(Y.yaml_rows(F.col("d.text")), "y"))
    y, spec = F.col("y"), F.col("spec")
    return docs.where(Y.value_at(y, "kind") != "").select("*", once(Y.under(y, "spec"), "spec")).select(
        *keys, "file", "doc", Y.value_at(y, "kind").alias("kind"), Y.value_at(y, "metadata", "name").alias("name"), Y.value_at(y, "metadata", "namespace").alias("namespace"),
        Y.values_at(spec, "**", "image").alias("images"), F.concat(Y.values_at(spec, "**", "containerPort"), Y.values_at(spec, "**", "port")).alias("ports"),
        Y.value_at(y, "spec", "replicas").try_cast("int").alias("replicas"))


def terraform(files: DataFrame, keys: Keys) -> DataFrame:
    """Resource, data, module and provider blocks with their line."""
    found = groups_sql("text", r'^(resource|data|module|provider)\s+"([^"]+)"(?:\s+"([^"]+)")?', 3, 0)
    rows = _routed(files, keys, "terraform").withColumn("text", unmarked("text")).select(*keys, "file", F.explode_outer(F.expr(found)).alias("x")).where("x IS NOT NULL")
    g = F.col("x.g")
    return rows.select(
        *keys, "file", g[0].alias("block"), g[1].alias("type"), g[2].alias("name"),
        F.when(g[0].isin("resource", "data"), F.substring_index(g[1], "_", 1)).otherwise(g[1]).alias("provider"), F.col("x.line").alias("line"))


JOB = "array<struct<name:string,stage:string,runs_on:string,uses:array<string>,commands:array<string>,needs:array<string>>>"


def pipelines(files: DataFrame, keys: Keys) -> DataFrame:
    """CI definitions with triggers and jobs. A command is a one-line ``run`` or the first line of a longer one."""
    none = M.empty_strings()

    def job(name: Column, stage: Column | str = "", runs: Column | str = "", uses=None, commands=None, needs=None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(name.alias("name"), lit(stage).alias("stage"), lit(runs).alias("runs_on"), (none if uses is None else uses).alias("uses"),
                        (none if commands is None else commands).alias("commands"), (none if needs is None else needs).alias("needs"))

    y, jobs = F.col("y"), F.col("jobs")

    def action_job(name: Column) -> Column:
        return bound(_named(jobs, name), lambda rows: action_rows(name, rows))

    def action_rows(name: Column, rows: Column) -> Column:
        steps = F.filter(rows, lambda r: (F.size(r["path"]) == 3) & (r["path"][0] == "steps"))
        runs = F.filter(steps, lambda r: (r["path"][2] == "run") & (r["value"] != ""))
        first = bound(runs, lambda runs: F.filter(runs, lambda r, k: (k == 0) | (F.get(runs, k - 1)["path"][1] != r["path"][1])))
        return job(name, "", F.concat_ws(", ", Y.list_at(rows, "runs-on")), Y.values_at(rows, "steps", "*", "uses"), F.transform(first, lambda r: r["value"]), Y.list_at(rows, "needs"))

    is_map = lambda name: F.exists(jobs, lambda r: (F.size(r["path"]) > 1) & (r["path"][0] == name))
    triggers = F.when(F.size(Y.list_at(y, "on")) > 0, Y.list_at(y, "on")).otherwise(Y.list_at(y, "true"))
    actions = _outlined(files, keys, "actions").select("*", once(Y.under(y, "jobs"), "jobs")).select(
        *keys, "file", F.lit("GitHub Actions").alias("system"), F.when(Y.value_at(y, "name") != "", Y.value_at(y, "name")).otherwise(basename("file")).alias("name"),
        triggers.alias("triggers"), F.transform(F.filter(_children(jobs), is_map), action_job).cast(JOB).alias("jobs"))
    tops = F.array_distinct(F.transform(F.filter(y, lambda r: (F.size(r["path"]) == 2) & r["path"][1].isin("script", "steps", "stage") & ~r["path"][0].isin(*NOT_JOBS)), lambda r: r["path"][0]))
    generic = _outlined(files, keys, "pipeline").select(
        *keys, "file", basename("file").alias("system"), basename("file").alias("name"), none.alias("triggers"),
        F.transform(tops, lambda name: job(name, Y.value_at(_named(y, name), "stage"))).cast(JOB).alias("jobs"))
    stages = F.transform(_all(r"stage\(['\"]([^'\"]+)", 1), lambda s: job(s))
    jenkins = _routed(files, keys, "jenkins").select(
        *keys, "file", F.lit("Jenkins").alias("system"), basename("file").alias("name"), none.alias("triggers"), stages.cast(JOB).alias("jobs"))
    return actions.unionByName(generic).unionByName(jenkins)


def serverless(files: DataFrame, keys: Keys) -> DataFrame:
    """Services with provider, runtime and functions; an event is named by its first key or by itself."""
    y, fns = F.col("y"), F.col("fns")

    def fn(name: Column) -> Column:
        return bound(_named(fns, name), lambda rows: fn_rows(name, rows))

    def fn_rows(name: Column, rows: Column) -> Column:
        events = F.filter(rows, lambda r: (F.size(r["path"]).between(2, 3)) & (r["path"][0] == "events") & ~r["text"])
        first = bound(events, lambda events: F.filter(events, lambda r, k: (k == 0) | (F.get(events, k - 1)["path"][1] != r["path"][1])))
        return F.struct(name.alias("name"), Y.value_at(rows, "handler").alias("handler"),
                        F.transform(first, lambda r: F.when(F.size(r["path"]) == 3, F.get(r["path"], F.lit(2))).otherwise(r["value"])).alias("events"))

    return _outlined(files, keys, "serverless").select("*", once(Y.under(y, "functions"), "fns")).select(
        *keys, "file", Y.value_at(y, "service").alias("service"), Y.value_at(y, "provider", "name").alias("provider"), Y.value_at(y, "provider", "runtime").alias("runtime"),
        F.transform(_children(fns), fn).alias("functions"))


def helm(files: DataFrame, keys: Keys) -> DataFrame:
    """Name, version and description of charts; a description over several lines is joined by blanks."""
    y = F.col("y")
    whole = lambda k: F.concat_ws(" ", F.transform(F.filter(y, lambda r: (F.size(r["path"]) == 1) & (r["path"][0] == k) & (r["value"] != "")), lambda r: r["value"])).alias(k)
    return _outlined(files, keys, "helm").select(*keys, "file", whole("name"), whole("version"), whole("description"))


def image_uses(cont: DataFrame, k8s: DataFrame, tf: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, file, line, note, service, name, kind, technology)``: every place where an image or resource reveals a
    backing system; the first matching rule names it. ``service`` is the compose service, '' elsewhere."""
    c = cont.where("image <> ''").select(
        *keys, "file", F.lit(0).alias("line"), F.concat(F.lit("service "), "name", F.lit(": "), "image").alias("note"), F.col("name").alias("service"), image_system("image").alias("s"))
    k = k8s.select(*keys, "file", "kind", "name", F.explode("images").alias("image")).select(
        *keys, "file", F.lit(0).alias("line"), F.concat_ws(" ", "kind", "name").alias("note"), F.lit("").alias("service"), image_system("image").alias("s"))
    t = tf.where("block = 'resource'").select(
        *keys, "file", "line", F.col("type").alias("note"), F.lit("").alias("service"), image_system(F.replace(F.col("type"), F.lit("_"), F.lit(" "))).alias("s"))
    return c.unionByName(k).unionByName(t).where("s IS NOT NULL").select(*keys, "file", "line", "note", "service", "s.*")


def image_systems(rows: DataFrame, keys: Keys, max_evidence: int = 12) -> DataFrame:
    """One row per backing system with the number of its uses and the first evidence rows; see ``image_uses``."""
    by = [*keys, "name", "kind", "technology"]
    item = F.struct("file", "line", F.lit("").alias("snippet"), "note")
    listed = capped_list(rows, by, ["file", "line", "note"], item, max_evidence, "evidence")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("uses")).join(shuffled(listed), by).withColumn("id", F.concat(F.lit("ext-"), slug("name")))


def _build_dir(col: str) -> Column:
    return F.btrim(F.col(col), F.lit("./"))


def container_edges(cont: DataFrame, apps: DataFrame, keys: Keys) -> DataFrame:
    """App -> app edges where the container of one depends on the container of the other."""
    at = apps.select(*keys, F.col("root").alias("build_dir"), F.col("id").alias("app"))
    owned = cont.select(*keys, "file", "name", _build_dir("build").alias("build_dir"), "depends_on").where("build_dir <> ''").join(shuffled(at), [*keys, "build_dir"])
    wants = owned.select(*keys, "file", F.col("name").alias("from_name"), F.col("app").alias("source"), F.explode("depends_on").alias("name"))
    return wants.join(shuffled(owned.select(*keys, "file", "name", F.col("app").alias("target"))), [*keys, "file", "name"]).select(
        *keys, "source", "target", F.lit("deploy").alias("kind"), F.lit(1).cast("long").alias("weight"), F.lit("depends_on").alias("label"),
        F.struct("file", F.concat(F.col("from_name"), F.lit(" -> "), "name").alias("note")).alias("evidence"))


def compose_systems(cont: DataFrame, uses: DataFrame, systems: DataFrame, apps: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, id, app)``: a system that runs as a service belongs to the apps whose services depend on it.

    ``uses`` are all places of ``image_uses``; evidence lists are for show and are not read.
    """
    named = systems.select(*keys, "id", F.col("name").alias("system"))
    service = uses.where("service <> ''").select(*keys, "file", F.col("service"), F.col("name").alias("system")).distinct().join(shuffled(named), [*keys, "system"]).select(
        *keys, "file", "id", F.col("service").alias("name"))
    at = apps.where("root <> ''").select(*keys, F.col("root").alias("build_dir"), F.col("id").alias("app"))
    wants = cont.select(*keys, "file", _build_dir("build").alias("build_dir"), F.explode("depends_on").alias("name")).join(shuffled(at), [*keys, "build_dir"])
    return wants.join(shuffled(service), [*keys, "file", "name"]).select(*keys, "id", "app").distinct()
