"""Published tables and documents.

A document may be larger than one row or one task, so documents are tables of text lines
``(repo, section, ord, line)``; written in that order, the lines form the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.operators.graph import edge_order
from codecensus.operators.windows import numbered, top_per_group

Keys = list[str]
SEMI = "; "


def _join(col: str, sep: str = SEMI) -> Column:
    return F.array_join(col, sep)


def _cols(df: DataFrame, keys: Keys, spec: list[tuple[str, Column | str]]) -> DataFrame:
    return df.select(*keys, *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in spec])


def csv_tables(t: dict[str, DataFrame], keys: Keys) -> dict[str, DataFrame]:
    """The ten exports with fixed headers. ``t`` holds the census tables by name."""
    same = lambda *names: [(n, n) for n in names]
    first = F.coalesce(F.concat_ws(":", F.get("evidence", 0)["file"], F.get("evidence", 0)["line"].cast("string")), F.lit(""))
    layer = t["layers"].select(*keys, F.col("node").alias("id"), "layer")
    parts = t["components"].groupBy(*keys, F.col("app").alias("id")).agg(F.count(F.lit(1)).alias("n_components"))
    return {
        "findings": _cols(t["findings"], keys, same("severity", "category", "title", "identifier", "cwe", "file", "line", "package", "version", "fixed_version", "confidence")
                          + [("application", "app"), ("remediation", "remediation"), ("snippet", "snippet"), ("references", _join("references", " "))]),
        "dependencies": _cols(t["dependencies"], keys, same("name", "version", "ecosystem", "scope", "direct", "declared", "used", "purl")
                              + [("declared_in", _join("declared_in")), ("used_by_count", F.col("n_used_by")), ("applications", _join("apps"))]),
        "endpoints": _cols(t["endpoints"], keys, same("kind", "method", "path", "handler", "framework") + [("application", "app")] + same("component", "file", "line", "description")),
        "external_systems": _cols(t["systems"], keys, same("id", "name", "kind", "technology") + [
            ("direction", F.lit("outbound")), ("applications", _join("apps")), ("evidence_count", F.col("n_files")), ("first_evidence", first)]),
        "applications": _cols(t["apps"].join(parts, [*keys, "id"], "left").na.fill(0, ["n_components"]), keys, same("id", "name", "kind", "root") + [
            ("languages", _join("languages")), ("frameworks", _join("frameworks"))] + same("files", "loc", "architecture_style") + [
            ("components", "n_components"), ("manifests", _join("manifests")), ("description", "description")]),
        "components": _cols(t["components"].join(layer, [*keys, "id"], "left"), keys, same("id", "name") + [("application", "app")] + same("path", "kind") + [
            ("languages", _join("languages"))] + same("files", "loc", "layer")),
        "edges": _cols(t["edges"], keys, same("source", "target", "kind", "weight", "label")),
        "files": _cols(t["files"], keys, same("path", "language", "kind", "loc", "sloc", "size") + [("application", "app")] + same("component", "symbols")),
        "symbols": _cols(t["symbols"], keys, same("name", "kind", "file", "line") + [("application", "app")] + same("component", "signature")),
        "environment_variables": _cols(t["env_vars"], keys, same("name", "kind") + [("files", _join("files"))]),
    }


def write_csv(tables: dict[str, DataFrame], folder: str, keys: Keys) -> None:
    """One folder per table, partitioned by repository."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).partitionBy(*keys).csv(f"{folder}/{name}")


# --------------------------------------------------------------- workbook

def metric_rows(facts: DataFrame, keys: Keys, metrics: list[tuple[str, str]]) -> DataFrame:
    """Wide facts as ``(keys, ord, metric, value)`` rows."""
    arr = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for i, (label, c) in enumerate(metrics, 1)])
    return facts.select(*keys, F.explode(arr).alias("x")).select(*keys, "x.*")


def edge_names(edges: DataFrame, names: DataFrame, keys: Keys) -> DataFrame:
    """Edges with the names of both ends; an id without a name stays as it is."""
    src = names.select(*keys, F.col("id").alias("source"), F.col("name").alias("source_name"))
    dst = names.select(*keys, F.col("id").alias("target"), F.col("name").alias("target_name"))
    return edges.join(src, [*keys, "source"], "left").join(dst, [*keys, "target"], "left").withColumn(
        "source_name", F.coalesce("source_name", "source")).withColumn("target_name", F.coalesce("target_name", "target"))


def infrastructure_sheet(t: dict[str, DataFrame], keys: Keys) -> DataFrame:
    """Seven kinds of infrastructure in one table."""
    def rows(df: DataFrame, typ, name, detail, ports) -> DataFrame:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(*keys, lit(typ).alias("type"), lit(name).alias("name"), lit(detail).alias("detail"), lit(ports).alias("ports"), "file")

    c = F.col
    fn = t["serverless"].select(*keys, "file", F.explode("functions").alias("f"))
    return reduce(lambda a, b: a.unionByName(b), [
        rows(t["containers"], "compose service", c("name"), F.when(c("image") != "", c("image")).otherwise(F.concat(F.lit("build "), "build")), _join("ports", ", ")),
        rows(t["dockerfiles"], "dockerfile", c("file"), _join("base_images", ", "), F.array_join(c("ports").cast("array<string>"), ", ")),
        rows(t["kubernetes"], F.concat(F.lit("k8s "), "kind"), c("name"), _join("images", ", "), _join("ports", ", ")),
        rows(t["terraform"], F.concat(F.lit("terraform "), "block"), c("name"), c("type"), c("provider")),
        rows(t["pipelines"], "ci pipeline", c("name"), c("system"), _join("triggers", ", ")),
        rows(fn, "serverless function", c("f.name"), c("f.handler"), F.array_join("f.events", ", ")),
        rows(t["helm"], "helm chart", c("name"), c("description"), c("version")),
    ])


def workbook(t: dict[str, DataFrame], keys: Keys, top_files: int = 5000) -> dict[str, DataFrame]:
    """The eleven tables of the workbook."""
    csv = csv_tables(t, keys)
    names = t["components"].select(*keys, "id", "name").unionByName(t["apps"].select(*keys, "id", "name")).unionByName(t["systems"].select(*keys, "id", "name"))
    ends = t["endpoints"].groupBy(*keys, F.col("app").alias("id")).agg(F.count(F.lit(1)).alias("endpoints"))
    labels = [(n.replace("_", " ").capitalize(), n) for n in ("apps", "components", "scanned_files", "loc", "sloc", "endpoints", "dependencies", "external_systems", "test_files", "test_ratio", "doc_files", "cycles")]
    return {
        "Summary": metric_rows(t["metrics"], keys, labels), "Findings": csv["findings"], "Dependencies": csv["dependencies"], "Endpoints": csv["endpoints"],
        "External systems": csv["external_systems"], "Applications": csv["applications"].join(ends, [*keys, "id"], "left").na.fill(0, ["endpoints"]),
        "Components": csv["components"], "Dependency graph": edge_names(t["edges"], names, keys).orderBy(*edge_order()),
        "Infrastructure": infrastructure_sheet(t, keys), "Configuration": csv["environment_variables"],
        "Files": top_per_group(csv["files"], keys, [F.desc("loc"), "path"], top_files),
    }


# -------------------------------------------------------------- documents

def stable_uuid(seed: Column) -> Column:
    d = F.sha1(seed)
    return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))


def package_ref() -> Column:
    generic = F.concat(F.lit("pkg:generic/"), "name")
    return F.when(F.col("version") == "", generic).when(F.col("purl") != "", F.col("purl")).otherwise(F.concat_ws("@", generic, "version"))


def cyclonedx_components(deps: DataFrame, keys: Keys, tool: str = "codecensus") -> DataFrame:
    """One CycloneDX component per dependency, as a struct column."""
    prop = lambda k, v: F.struct(F.lit(f"{tool}:{k}").alias("name"), v.alias("value"))
    return deps.select(*keys, "ecosystem", "name", F.struct(
        F.lit("library").alias("type"), package_ref().alias("bom-ref"), F.col("name"), F.coalesce(F.nullif("version", F.lit("")), F.lit("unknown")).alias("version"), F.col("purl"),
        F.when(F.col("scope") == "runtime", "required").otherwise("optional").alias("scope"),
        F.array(prop("ecosystem", F.col("ecosystem")), prop("direct", F.col("direct").cast("string")), prop("used", F.col("used").cast("string")),
                prop("declaredIn", F.array_join("declared_in", ", "))).alias("properties"),
        F.when(F.col("license") != "", F.array(F.struct(F.struct(F.col("license").alias("name")).alias("license")))).alias("licenses")).alias("component"))


def cyclonedx_vulnerabilities(findings: DataFrame, deps: DataFrame, keys: Keys) -> DataFrame:
    """One vulnerability per advisory finding, pointing at the affected package."""
    vuln = findings.where((F.col("category") == "dependency") & F.col("identifier").rlike("^(CVE|GHSA|OSV|PYSEC|GO-)"))
    ref = deps.groupBy(*keys, F.col("name").alias("package")).agg(F.min(package_ref()).alias("ref"))
    cwes = F.transform(F.filter(F.split("cwe", ","), lambda c: F.btrim(c).rlike(r"^CWE-\d+$")), lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("int"))
    return vuln.join(ref, [*keys, "package"], "left").select(*keys, "package", "id", F.struct(
        F.col("id").alias("bom-ref"), F.col("identifier").alias("id"), F.col("title").alias("description"), F.array(F.struct("severity")).alias("ratings"), cwes.alias("cwes"),
        F.col("remediation").alias("recommendation"), F.array(F.struct(F.coalesce("ref", "package").alias("ref"))).alias("affects"),
        F.transform(F.filter("references", lambda u: u != ""), lambda u: F.struct(u.alias("url"))).alias("advisories")).alias("vulnerability"))


def _document(head: DataFrame, sections: list[tuple[str, DataFrame]], keys: Keys) -> DataFrame:
    """Lines of a JSON document: an opening line, one line per item, closing lines."""
    parts = [head.select(*keys, F.lit(0).alias("section"), F.lit(-1).cast("long").alias("ord"), "line")]
    for i, (name, items) in enumerate(sections, 1):
        opening = ("," if i > 0 else "") + f'"{name}":['
        parts.append(head.select(*keys, F.lit(i).alias("section"), F.lit(-1).cast("long").alias("ord"), F.lit(opening).alias("line")))
        parts.append(items.select(*keys, F.lit(i).alias("section"), F.col("n").alias("ord"), F.concat(F.when(F.col("n") > 0, ",").otherwise(""), "item").alias("line")))
        parts.append(head.select(*keys, F.lit(i).alias("section"), F.lit(2**62).cast("long").alias("ord"), F.lit("]" + ("}" if i == len(sections) else "")).alias("line")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def cyclonedx(deps: DataFrame, findings: DataFrame, repos: DataFrame, keys: Keys, generated_at: str = "", tool: str = "codecensus", version: str = "0.1.0") -> DataFrame:
    """CycloneDX 1.5 document lines. ``repos(keys)`` lists the repositories to write."""
    name = F.col(keys[0])
    meta = F.struct(
        F.lit(generated_at).alias("timestamp"), F.array(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"))).alias("tools"),
        F.struct(F.lit("application").alias("type"), F.concat(F.lit("root-"), name).alias("bom-ref"), name.alias("name"), F.lit("0.0.0").alias("version")).alias("component"))
    top = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.concat(F.lit("urn:uuid:"), stable_uuid(F.concat(name, F.lit(generated_at)))).alias("serialNumber"), F.lit(1).alias("version"), meta.alias("metadata")))
    head = repos.select(*keys, F.regexp_replace(top, r"\}$", "").alias("line"))
    comps = numbered(cyclonedx_components(deps, keys, tool), keys, ["ecosystem", "name"]).select(*keys, "n", F.to_json("component").alias("item"))
    vulns = numbered(cyclonedx_vulnerabilities(findings, deps, keys), keys, ["package", "id"]).select(*keys, "n", F.to_json("vulnerability").alias("item"))
    return _document(head, [("components", comps), ("vulnerabilities", vulns)], keys)


def spdx_packages(deps: DataFrame, keys: Keys) -> DataFrame:
    """SPDX packages numbered in (ecosystem, name) order."""
    none = "NOASSERTION"
    d = numbered(deps, keys, ["ecosystem", F.lower("name"), "name"])
    lic = F.coalesce(F.nullif("license", F.lit("")), F.lit(none))
    ref = F.when(F.col("purl") != "", F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))).otherwise(
        F.expr("cast(array() as array<struct<referenceCategory:string,referenceType:string,referenceLocator:string>>)"))
    return d.select(*keys, "n", F.concat(F.lit("SPDXRef-Package-"), F.col("n").cast("string")).alias("spdx_id"), F.struct(
        F.concat(F.lit("SPDXRef-Package-"), F.col("n").cast("string")).alias("SPDXID"), F.col("name"), F.coalesce(F.nullif("version", F.lit("")), F.lit(none)).alias("versionInfo"),
        F.lit(none).alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), lic.alias("licenseConcluded"), lic.alias("licenseDeclared"), F.lit(none).alias("copyrightText"), ref.alias("externalRefs")).alias("package"))


def spdx(deps: DataFrame, repos: DataFrame, keys: Keys, generated_at: str = "", tool: str = "codecensus", version: str = "0.1.0") -> DataFrame:
    """SPDX 2.3 document lines."""
    name = F.col(keys[0])
    top = F.to_json(F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.concat(name, F.lit("-sbom")).alias("name"),
        F.concat(F.lit(f"https://spdx.org/spdxdocs/{tool}-"), stable_uuid(name)).alias("documentNamespace"),
        F.struct(F.lit(generated_at).alias("created"), F.array(F.lit(f"Tool: {tool}-{version}")).alias("creators")).alias("creationInfo")))
    head = repos.select(*keys, F.regexp_replace(top, r"\}$", "").alias("line"))
    root = F.to_json(F.struct(F.lit("SPDXRef-Package-root").alias("SPDXID"), name.alias("name"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
                              F.lit("NOASSERTION").alias("versionInfo"), F.lit("NOASSERTION").alias("licenseConcluded"), F.lit("NOASSERTION").alias("licenseDeclared"), F.lit("NOASSERTION").alias("copyrightText")))
    link = lambda a, b, t: F.to_json(F.struct(F.lit(a).alias("spdxElementId"), b.alias("relatedSpdxElement"), F.lit(t).alias("relationshipType")))
    p = spdx_packages(deps, keys)
    packages = repos.select(*keys, F.lit(0).cast("long").alias("n"), root.alias("item")).unionByName(p.select(*keys, (F.col("n") + 1).alias("n"), F.to_json("package").alias("item")))
    relations = repos.select(*keys, F.lit(0).cast("long").alias("n"), link("SPDXRef-DOCUMENT", F.lit("SPDXRef-Package-root"), "DESCRIBES").alias("item")).unionByName(
        p.select(*keys, (F.col("n") + 1).alias("n"), link("SPDXRef-Package-root", F.col("spdx_id"), "DEPENDS_ON").alias("item")))
    return _document(head, [("packages", packages), ("relationships", relations)], keys)


def model_lines(t: dict[str, DataFrame], keys: Keys) -> DataFrame:
    """The whole model as ``(keys, section, json)``: one JSON object per entity."""
    return reduce(lambda a, b: a.unionByName(b), [
        df.select(*keys, F.lit(name).alias("section"), F.to_json(F.struct(*[c for c in df.columns if c not in keys]), {"ignoreNullFields": "false"}).alias("json")) for name, df in t.items()])


def write_document(lines: DataFrame, folder: str, keys: Keys) -> None:
    """Text files per repository whose parts, in name order, form the document."""
    ordered = lines.repartitionByRange(*[F.col(k) for k in keys], F.col("section"), F.col("ord")).sortWithinPartitions(*keys, "section", "ord")
    ordered.select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(folder)


def headline(metric: DataFrame, summary: DataFrame, profile: DataFrame, keys: Keys) -> DataFrame:
    """The manifest row of every repository as JSON."""
    row = metric.join(summary.select(*keys, "risk_level"), keys).join(profile.select(*keys, "profile"), keys)
    return row.select(*keys, F.to_json(F.struct(
        F.struct(F.col("apps").alias("applications"), "components", F.col("scanned_files").alias("files"), "loc", "endpoints", "dependencies", "external_systems",
                 F.col("findings_by_severity").alias("findings"), "risk_level").alias("summary"), "profile")).alias("manifest"))


def graph_payload(comps: DataFrame, systems: DataFrame, edges: DataFrame, keys: Keys, max_nodes: int = 260) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of the interactive graph.

    The largest components and all systems are nodes; links keep both ends; an app's link
    to a system hangs on the app's largest shown component.
    """
    shown = top_per_group(comps, keys, [F.desc("files"), "id"], max_nodes, rank="rank")
    nodes = shown.select(*keys, "id", F.col("name").alias("label"), F.lit("component").alias("kind"), "app", F.greatest("files", F.lit(1)).cast("long").alias("size")).unionByName(
        systems.select(*keys, "id", F.col("name").alias("label"), "kind", F.lit("").alias("app"), F.greatest(F.size("evidence") * 2, F.lit(2)).cast("long").alias("size")))
    ids = nodes.select(*keys, "id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), [*keys, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [*keys, "target"], "left_semi").select(*keys, "source", "target", "weight")
    host = shown.groupBy(*keys, "app").agg(F.min_by("id", "rank").alias("host"))
    hung = edges.where(F.col("kind").isin("db", "cache", "queue", "storage", "http")).join(ids.withColumnRenamed("id", "target"), [*keys, "target"], "left_semi").join(
        host.withColumnRenamed("app", "source"), [*keys, "source"]).select(*keys, F.col("host").alias("source"), "target", F.lit(1).cast("long").alias("weight"))
    return nodes, inner.unionByName(hung)
