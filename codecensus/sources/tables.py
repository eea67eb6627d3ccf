"""Commit logs, advisory dumps, saved models and review answers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ADVISORY_SCHEMA = (
    "id string, summary string, details string, aliases array<string>, "
    "severity array<struct<type:string,score:string>>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>, "
    "references array<struct<type:string,url:string>>, database_specific struct<severity:string,cwe_ids:array<string>>, withdrawn string"
)
ANSWER_SCHEMA = (
    "schema string, generated_by struct<tool:string,model:string,generated_at:string,notes:string>, "
    "applications array<struct<id:string,summary:string,responsibilities:array<string>,evidence:array<string>>>, "
    "components array<struct<id:string,summary:string,evidence:array<string>>>, "
    "flows array<struct<id:string,narrative:string,evidence:array<string>>>, "
    "findings array<struct<id:string,assessment:string,reasoning:string,evidence:array<string>>>, "
    "diagrams array<struct<id:string,caption:string>>, "
    "insights array<struct<id:string,kind:string,title:string,detail:string,severity:string,confidence:string,targets:array<string>,evidence:array<string>>>, "
    "unanswered array<string>, _corrupt_record string"
)
# Sections of a saved model and the columns read back; what a file lacks becomes a default.
MODEL_SECTIONS = {
    "apps": "struct<id:string,name:string,root:string,kind:string,languages:array<string>,frameworks:array<string>,files:bigint,loc:bigint,description:string,purpose:string,architecture_style:string>",
    "components": "struct<id:string,name:string,path:string,app:string,kind:string,languages:array<string>,files:bigint,loc:bigint,description:string>",
    "files": "struct<path:string,language:string,kind:string,loc:bigint,sloc:bigint,size:bigint,app:string,component:string>",
    "symbols": "struct<name:string,kind:string,file:string,line:int,app:string,component:string,signature:string,exported:boolean>",
    "edges": "struct<source:string,target:string,kind:string,weight:bigint,label:string>",
    "dependencies": "struct<name:string,version:string,ecosystem:string,scope:string,declared_in:array<string>,direct:boolean,declared:boolean,used:boolean,purl:string,license:string>",
    "endpoints": "struct<kind:string,method:string,path:string,handler:string,file:string,line:int,app:string,component:string,framework:string,description:string>",
    "external_systems": "struct<id:string,name:string,kind:string,technology:string,apps:array<string>,evidence:array<struct<file:string,line:int,snippet:string,note:string>>>",
    "findings": "struct<id:string,title:string,severity:string,category:string,file:string,line:int,snippet:string,cwe:string,package:string,version:string,fixed_version:string,identifier:string,confidence:string,remediation:string,references:array<string>,app:string>",
}


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """``(repo, ord, author, ts)`` from tab-separated log lines ``repo  ord  author  date``."""
    return spark.read.schema("repo string, ord int, author string, ts string").option("sep", "\t").csv(path)


def read_commit_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("repo string, ord int, path string").option("sep", "\t").csv(path)
    return raw.where(~F.col("path").startswith("Binary") & ~F.col("path").startswith("commit "))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """One row per advisory and affected package, from OSV-shaped JSON documents."""
    raw = spark.read.schema(ADVISORY_SCHEMA).option("multiLine", True).json(path)
    return advisories(raw)


def _spans(r: Column) -> Column:
    events = r["events"]

    def span(e: Column, i: Column) -> Column:
        end = F.get(F.filter(events, lambda x, j: (j > i) & x["introduced"].isNull()), 0)
        return F.struct(e["introduced"].alias("introduced"), end["fixed"].alias("fixed"), end["last_affected"].alias("last_affected"))

    return F.filter(F.transform(events, span), lambda s: s["introduced"].isNotNull())


def advisories(raw: DataFrame) -> DataFrame:
    """Rows of advisory documents; withdrawn ones are left out."""
    if "withdrawn" in raw.columns:
        raw = raw.where(F.coalesce("withdrawn", F.lit("")) == "")
    a = raw.select("*", F.explode("affected").alias("a"))
    return a.select(
        "id", F.coalesce("aliases", F.expr("cast(array() as array<string>)")).alias("aliases"), F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"),
        F.coalesce("a.versions", F.expr("cast(array() as array<string>)")).alias("versions"),
        # A range is a list of events: each introduction ends at the next event that is a fix or the last affected version.
        F.flatten(F.transform(F.coalesce("a.ranges", F.expr("cast(array() as array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>)")), _spans)).alias("events"),
        F.coalesce("severity", F.expr("cast(array() as array<struct<type:string,score:string>>)")).alias("severity"), F.coalesce("database_specific.severity", F.lit("")).alias("label"),
        F.coalesce(F.nullif("summary", F.lit("")), F.col("details"), F.lit("")).alias("summary"),
        F.coalesce("database_specific.cwe_ids", F.expr("cast(array() as array<string>)")).alias("cwe_ids"),
        F.coalesce(F.transform("references", lambda r: r["url"]), F.expr("cast(array() as array<string>)")).alias("refs"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Review answers; a damaged file yields a row with ``_corrupt_record``."""
    return spark.read.schema(ANSWER_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def answer_rows(answers: DataFrame, section: str, repo: str) -> DataFrame:
    """One row per answer of a section, with its position."""
    return answers.select(F.lit(repo).alias("repo"), F.posexplode(section).alias("ord", "x")).select("repo", "ord", "x.*")


def model_section(lines: DataFrame, section: str) -> DataFrame:
    """Rows of one section of model lines ``(repo, section, json)``; unknown keys are ignored."""
    x = F.from_json("json", MODEL_SECTIONS[section])
    return _defaults(lines.where(F.col("section") == section).select("repo", x.alias("x")).select("repo", "x.*"))


def read_model(spark: SparkSession, path: str, section: str, repo: str) -> DataFrame:
    """Rows of one section of saved model documents (one JSON object per file)."""
    raw = spark.read.schema(f"{section} array<{MODEL_SECTIONS[section]}>").option("multiLine", True).json(path)
    return _defaults(raw.select(F.lit(repo).alias("repo"), F.explode(section).alias("x")).select("repo", "x.*"))


def model_items(lines: DataFrame) -> DataFrame:
    """``(repo, section, item)`` of model lines ``(repo, section, json)``; the item is a VARIANT that keeps every key."""
    return lines.select("repo", "section", F.parse_json("json").alias("item"))


def read_models(spark: SparkSession, path: str, repo_pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """``(repo, section, ord, item)`` of all saved model documents below ``path``, read in one pass.

    Every top-level key is a section: a list gives a row for each entry, anything else one row with the position 0.
    Nothing is left out, known or not. The repository is the first group of ``repo_pattern`` in the file's path.
    """
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), repo_pattern, 1).alias("repo"), F.parse_json("value").alias("doc"))
    parts = raw.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()).select(F.col("key").alias("section"), F.col("value").alias("part")))
    is_list = F.schema_of_variant("part").startswith("ARRAY")
    many = parts.where(is_list).select("repo", "section", "part").lateralJoin(
        spark.tvf.variant_explode(F.col("part").outer()).select(F.col("pos").alias("ord"), F.col("value").alias("item"))).select("repo", "section", "ord", "item")
    return many.unionByName(parts.where(~is_list).select("repo", "section", F.lit(0).alias("ord"), F.col("part").alias("item")))


def item_schema(items: DataFrame, section: str) -> str:
    """Type of a section's items over all repositories, as it is found in them."""
    found = items.where(F.col("section") == section).agg(F.schema_of_variant_agg("item")).first()[0]
    return found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")


def section_rows(items: DataFrame, section: str, fields: str | None = None, aside: str | None = None) -> DataFrame:
    """Rows of one section with its columns typed; ``fields`` is a struct's inside (``a int, b array<string>``).

    Without it the columns of a known section are used, and those found in the items of any other. With ``aside`` the
    items stay beside the columns under that name, with the keys that no column has.
    """
    of = items.where(F.col("section") == section)
    if fields is not None:
        kind = f"struct<{fields}>"
    elif section in MODEL_SECTIONS:
        kind = MODEL_SECTIONS[section]
    else:
        kind = item_schema(items, section)
    typed = of.select("repo", "item", F.variant_get("item", "$", kind).alias("x"))
    plain = typed.select("repo", "x.*") if aside is None else typed.select("repo", F.col("item").alias(aside), "x.*")
    return _defaults(plain) if section in MODEL_SECTIONS and fields is None and aside is None else plain


def _defaults(df: DataFrame) -> DataFrame:
    """Missing text is '', missing numbers 0, missing flags false, missing lists empty."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        default = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0), "boolean": F.lit(False)}.get(t)
        cols.append((F.coalesce(f.name, default if default is not None else F.expr(f"cast(array() as {t})")) if t != "double" else F.col(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*cols)
