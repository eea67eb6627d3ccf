"""The whole analysis: raw files of many repositories in, published tables out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from codecensus.functions.text import basename
from codecensus.operators import deps as D
from codecensus.operators import flows as FL
from codecensus.operators import graph as G
from codecensus.operators import group as GR
from codecensus.operators import infra as I
from codecensus.operators import manifests as M
from codecensus.operators import models as MO
from codecensus.operators import report as RP
from codecensus.operators import resolve as R
from codecensus.operators import review as RV
from codecensus.operators import security as SE
from codecensus.operators import symbols as SY
from codecensus.operators import systems as S
from codecensus.rules import languages as L
from codecensus.rules import security as RULES
from codecensus.rules import systems as SIGS
from codecensus.session import stored
from codecensus.sources import files as SF

KEYS = ["repo"]


@dataclass
class Options:
    """Choices of one run; rule tables may be extended by the caller."""

    include_tests: bool = True
    max_file_size: int = 2_000_000
    extra_ignores: tuple[str, ...] = ()
    include_globs: tuple[str, ...] = ()
    use_gitignore: bool = True
    everything: bool = False
    max_flows_per_app: int = 8
    rules: tuple = RULES.RULES
    signatures: tuple = SIGS.SIGNATURES
    import_rules: tuple = L.IMPORTS
    symbol_rules: tuple = L.SYMBOLS
    endpoint_rules: tuple = L.ENDPOINTS
    manifest_formats: dict = field(default_factory=dict)
    lock_formats: dict = field(default_factory=dict)
    advisories: DataFrame | None = field(default=None)


def census(raw: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """``raw(repo, path, size, content)`` or ``raw(repo, path, size, text)`` to named tables.

    The decoded inventory is written once; every extractor reads only the languages and
    columns it needs from it. Facts are small next to the text and are stored as well
    where several later steps read them.
    """
    o = options or Options()
    k = KEYS
    rules = SF.ignore_rules(raw) if o.use_gitignore else None
    tagged = stored(SF.tag_files(raw, rules, o.extra_ignores, o.include_globs, o.max_file_size))
    inv = stored(SF.inventory(raw, tagged, o.include_tests))
    t: dict[str, DataFrame] = {"walk_stats": SF.walk_stats(tagged), "vendor_dirs": SF.vendor_dirs(tagged)}
    coded = inv.where(F.col("language").isin(*analysed_languages()))

    manifests = stored(M.manifests(inv, k))
    locked, asked = M.locked(inv, k), M.declared(manifests, k)
    if o.lock_formats:
        locked = locked.unionByName(M.extra_dependencies(inv, k, o.lock_formats))
    if o.manifest_formats:
        asked = asked.unionByName(M.extra_dependencies(inv, k, o.manifest_formats))
    imports = SY.imports(coded, k, o.import_rules)
    symbols = stored(SY.symbols(coded, k, o.symbol_rules))
    endpoints = stored(SY.endpoints(coded, k, o.endpoint_rules))
    marks = stored(SY.frameworks(coded, k))
    readmes = inv.where(F.lower(basename("path")).startswith("readme")).select(*k, "path", GR.readme_summary("text").alias("summary"))

    # --- applications and components
    roots = stored(GR.app_roots(inv.select(*k, "path", "kind"), manifests, k))
    rooted = GR.deepest_prefix(inv.select(*k, "path", "language", "kind", "loc", "sloc", "size"), roots, k)
    rooted = stored(rooted)
    member = rooted.where("root IS NOT NULL")
    apps0 = stored(GR.build_apps(member, roots, manifests, marks, endpoints, readmes, k))
    apped = member.join(apps0.select(*k, "root", F.col("id").alias("app")), [*k, "root"])
    comps = stored(GR.components(apped, apps0, k))
    owner = GR.component_of_file(apped, comps, k)
    stray = rooted.where("root IS NULL").select(*k, "path", F.lit("").alias("app"), F.lit("").alias("component"))
    owner = stored(owner.unionByName(stray))
    t["components"], t["owners"] = comps, owner
    symbols, endpoints = GR.attach(symbols, owner, k), stored(GR.attach(endpoints, owner, k))

    # --- imports, dependencies
    resolved = stored(R.resolve(imports, inv.select(*k, "path", "language"), manifests, M.ts_aliases(inv, k), k))
    file_edges = stored(R.file_edges(resolved, k))
    usage = stored(R.external_usage(resolved, owner, k))
    reconciled = D.reconcile(asked, locked, k)
    matches = D.match_usage(reconciled, usage, k)
    optional = SE.optional_imports(inv, k)
    deps = stored(D.with_usage(reconciled, usage, matches, k))
    missing = stored(D.undeclared(usage, matches, optional, k))

    # --- systems and infrastructure
    hits = stored(S.signature_hits(inv, k, o.signatures))
    code_systems = S.systems_from_hits(hits, k)
    ids = hits.where("note = ''").select(*k, "id").distinct()
    host_rows = stored(S.suppress_known_hosts(S.hosts(inv, k), ids, k))
    cols = [*k, "id", "name", "kind", "technology", "evidence"]
    found = code_systems.select(*cols).unionByName(S.host_systems(host_rows, k).select(*cols))
    cont, k8s, tf = (stored(f(inv, k)) for f in (I.containers, I.kubernetes, I.terraform))
    image_uses = stored(I.image_uses(cont, k8s, tf, k))
    infra_systems = I.image_systems(image_uses, k)
    merged = stored(S.merge_systems(found, infra_systems, k))
    uses = hits.where("note = ''").select(*k, F.concat(F.lit("ext-"), "id").alias("id"), "file").unionByName(
        host_rows.select(*k, F.concat(F.lit("ext-host-"), S.slug("host")).alias("id"), "file")).unionByName(
        image_uses.select(*k, "name", "file").join(merged.select(*k, "name", "id"), [*k, "name"]).select(*k, "id", "file")).distinct()
    uses = stored(uses)
    systems = S.with_apps(merged, uses, owner, k)
    systems = systems.join(uses.groupBy(*k, "id").agg(F.countDistinct("file").alias("n_files")), [*k, "id"], "left").na.fill(0, ["n_files"])
    composed = I.compose_systems(cont, image_uses, merged, apps0, k).groupBy(*k, "id").agg(F.collect_set("app").alias("more"))
    systems = stored(systems.join(composed, [*k, "id"], "left").withColumn(
        "apps", F.array_sort(F.array_union("apps", F.coalesce("more", F.expr("cast(array() as array<string>)"))))).drop("more"))

    # --- graphs
    to = owner.where("component <> ''")
    comp_edges = stored(G.lift_edges(file_edges, to.select(*k, F.col("path").alias("node"), F.col("component").alias("group")), k))
    app_edges = stored(G.lift_edges(file_edges, to.select(*k, F.col("path").alias("node"), F.col("app").alias("group")), k, kind="depends"))
    sys_edges, deploy = G.system_edges(systems, k), I.container_edges(cont, apps0, k).drop("evidence")
    nodes = comps.select(*k, F.col("id").alias("node"))
    fans = stored(G.fan(comp_edges, k))
    cycles = G.components(comp_edges, k)
    layer = G.layers(nodes, comp_edges, k, scc=cycles)
    ranks = G.pagerank(nodes, comp_edges, k)
    label = F.lit("").alias("label")
    links = [*k, "source", "target", "kind", "weight"]
    edges = comp_edges.select(*links, label).unionByName(app_edges.select(*links, label)).unionByName(sys_edges.select(*links, "label")).unionByName(deploy.select(*links, "label"))

    # --- findings
    order = [*k, *SE.FINDING]
    parts = [SE.scan_secrets(inv, k), SE.scan_rules(inv, k, o.rules), D.hygiene_findings(deps, inv.where(M.lock_format("path").isNotNull()).select(*k, "path"), k), D.usage_findings(deps, missing, k)]
    if o.advisories is not None:
        parts.append(D.advisory_findings(deps, o.advisories, k))
    all_findings = None
    for i, p in enumerate(parts):
        p = p.select(*order).withColumn("ord", F.lit(i))
        all_findings = p if all_findings is None else all_findings.unionByName(p)
    findings = SE.dedupe_findings(all_findings, k, ["ord", "identifier", "line", "id"]).drop("ord")
    findings = stored(GR.attach(findings, owner, k).drop("component"))

    # --- purpose, flows, models
    nouns = GR.domain_nouns(endpoints, symbols, [*k, "app"])
    said = RP.purpose(apps0, endpoints, nouns, systems, app_edges.select(*links).unionByName(deploy.select(*links)), k)
    apps = stored(apps0.join(said, [*k, "id"]).withColumn("description", F.when(F.col("description") != "", F.col("description")).otherwise(F.col("purpose"))))
    texts = inv.join(endpoints.select(*k, F.col("file").alias("path")).distinct(), [*k, "path"], "left_semi").select(*k, "path", "text")
    by_file = stored(S.systems_by_file(uses, systems, k))
    flows, flow_nodes, flow_edges = FL.build_flows(endpoints, file_edges, owner, by_file, systems, texts, apps, k, o.max_flows_per_app)
    flows = stored(flows)
    over_nodes, over_edges = FL.overview_flows(apps, endpoints, systems, k)
    elements = MO.c4_elements(apps, comps, systems, endpoints, k)
    a_elements = stored(MO.archimate_elements(apps, comps, systems, endpoints, flows, cont, k8s, k))

    # --- metrics, summary, profile
    dock, ci = stored(I.dockerfiles(inv, k)), stored(I.pipelines(inv, k))
    metric = stored(RP.metrics(inv, apps, comps, endpoints, deps, systems, findings, fans, cycles, k))
    n = lambda df, name: df.groupBy(*k).agg(F.count(F.lit(1)).alias(name))
    kinds = apps.groupBy(*k).agg(
        F.min("kind").alias("app_kind"), *[F.count_if(F.col("kind") == kind).alias(col) for kind, col in (("frontend", "frontends"), ("cli", "clis"), ("library", "libraries"))])
    facts = metric.withColumn("total", F.col("scanned_files")).withColumn("findings", F.aggregate(F.map_values("findings_by_severity"), F.lit(0).cast("long"), lambda a, v: a + v))
    extra = [n(cont, "containers"), n(k8s, "workloads"), n(tf, "terraform"), n(dock, "dockerfiles"), n(ci, "pipelines"), n(comp_edges, "import_edges"), n(flows, "flows"),
             n(symbols.where("kind = 'table'"), "tables"), n(missing, "undeclared"), kinds, R.unresolved_counts(resolved, k)]
    for e in extra:
        facts = facts.join(e, k, "left")
    facts = facts.na.fill(0).na.fill("application", ["app_kind"])
    facts = facts.withColumn("has_deployment", F.col("containers") + F.col("workloads") > 0).withColumn(
        "has_infra", F.col("containers") + F.col("workloads") + F.col("terraform") + F.col("pipelines") + F.col("dockerfiles") > 0)
    facts = stored(RP.profile(facts))
    flags = facts.select(*k, (F.col("pipelines") > 0).alias("has_ci"), (F.col("containers") + F.col("dockerfiles") > 0).alias("has_containers"), (F.col("terraform") + F.col("workloads") > 0).alias("has_iac"))
    summary = RP.summary(metric, apps, systems, flags, k)
    decisions = stored(RP.artifact_decisions(facts, k, o.everything))
    overview = RP.overview_points(facts, endpoints, systems, findings, k)
    top = RP.top_components(comps, ranks, fans, k)
    sym_count = symbols.groupBy(*k, F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("symbols"))
    files = inv.drop("text").join(owner, [*k, "path"], "left").join(sym_count, [*k, "path"], "left").na.fill(0, ["symbols"]).na.fill("", ["app", "component"])

    t.update({
        "files": files, "manifests": manifests, "imports": resolved, "symbols": symbols, "endpoints": endpoints, "apps": apps, "file_edges": file_edges, "edges": edges,
        "component_edges": comp_edges, "app_edges": app_edges, "dependencies": deps, "undeclared": missing, "systems": systems, "env_vars": S.env_vars(inv, k), "findings": findings,
        "containers": cont, "dockerfiles": dock, "kubernetes": k8s, "terraform": tf, "pipelines": ci, "serverless": I.serverless(inv, k), "helm": I.helm(inv, k),
        "fans": fans, "cycles": cycles, "layers": layer, "ranks": ranks, "flows": flows, "flow_nodes": flow_nodes, "flow_edges": flow_edges, "overview_nodes": over_nodes,
        "overview_edges": over_edges, "messages": FL.lane_messages(flow_nodes, flow_edges, k), "c4_elements": elements,
        "c4_relations": MO.c4_relations(elements, apps, app_edges, comp_edges, sys_edges, k), "archimate_elements": a_elements,
        "archimate_relations": MO.archimate_relations(a_elements, apps, comps, systems, endpoints, flows, app_edges, comp_edges, sys_edges, k),
        "metrics": metric, "facts": facts, "summary": summary, "decisions": decisions, "overview": overview, "top_components": top,
        "questions": RV.questions(apps, comps, flows, findings, systems, R.unresolved_counts(resolved, k), decisions, k),
    })
    return t


def analysed_languages() -> tuple[str, ...]:
    from codecensus.rules.files import CODE_LANGUAGES, SCHEMA_LANGUAGES

    return CODE_LANGUAGES + SCHEMA_LANGUAGES
