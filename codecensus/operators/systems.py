"""External systems, outbound hosts and environment variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.functions import evidence as V
from codecensus.functions.classify import env_kind
from codecensus.functions.guards import holds_sql, pieces_sql
from codecensus.functions.matching import docstring_spans, find_lines, in_spans, quoted
from codecensus.functions.text import slug, strip
from codecensus.operators.windows import capped_list, first_wins, top_per_group
from codecensus.rules import systems as R
from codecensus.session import once

Keys = list[str]
PROSE_KINDS = ("docs", "data")


def signature_hits(files: DataFrame, keys: Keys, signatures=R.SIGNATURES) -> DataFrame:
    """First hit per (file, signature) with its judgement: use, prose mention or pattern definition.

    Whether a file is a catalogue of patterns depends on all its hits; they sit in one
    array of one row, so no shuffle is needed to judge.
    """
    signatures = list(signatures)
    patterns = [s[4] for s in signatures]
    text, path = F.col("text"), F.col("path")
    per_sig = ", ".join(
        f"CASE WHEN {holds_sql(s[4], patterns, 'pieces', 'text')} THEN named_struct('i', {i}, 'at', regexp_instr(text, {p}), 'hit', regexp_extract(text, {p}, 0)) END"
        for i, (s, p) in enumerate((s, quoted("(?i)" + s[4])) for s in signatures))
    meta = F.expr("array(" + ", ".join(
        f"named_struct('id', {quoted(s[0])}, 'name', {quoted(s[1])}, 'kind', {quoted(s[2])}, 'technology', {quoted(s[3])})"
        for s in signatures) + ")")

    def place(h):
        before = F.left(text, h["at"] - 1)
        head = F.substring_index(before, "\n", -1)
        line = (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")
        shown = strip(F.concat(head, F.substring_index(F.substr(text, h["at"]), "\n", 1)))
        return F.struct(
            h["i"].alias("i"), line.alias("line"), shown.alias("snippet"),
            (V.is_comment_line(shown) | F.when(F.col("docs").isNull(), False).otherwise(
                in_spans(F.col("docs"), line, F.length(head)))).alias("prose"),
            V.is_whole_raw_string(shown, h["hit"]).alias("raw"))

    hits = (
        files.where(F.col("text") != "").select(*keys, "path", "kind", "text", F.lower("text").alias("low"))
        .select(*keys, "path", "kind", "text", once(F.expr(pieces_sql(patterns, "low")), "pieces"))
        .select(*keys, "path", "kind", "text", F.expr(f"array_compact(array({per_sig}))").alias("found"))
        .withColumn("docs", F.when(path.endswith(".py"), F.expr(docstring_spans("text"))))
        .select(*keys, "path", "kind", F.transform("found", place).alias("hits"))
    )
    hs = F.col("hits")
    spoken = F.filter(hs, lambda h: h["snippet"] != "")
    defined = F.size(F.filter(spoken, lambda h: V.is_pattern_definition(h["snippet"])))
    catalogue = (F.size(spoken) >= 4) & (defined * 3 >= F.size(spoken))
    prose_lines = F.transform(F.filter(hs, lambda h: h["prose"]), lambda h: h["line"])
    raw_lines = F.transform(F.filter(hs, lambda h: h["raw"]), lambda h: h["line"])
    judged = hits.select(
        *keys, "path", F.col("kind").alias("file_kind"), catalogue.alias("catalogue"),
        prose_lines.alias("pl"), raw_lines.alias("rl"), F.explode_outer("hits").alias("h"),
    ).where("h IS NOT NULL")
    # explode_outer: a plain explode of a computed column lets the optimizer repeat the whole
    # scan in a "has elements" filter below it.
    documented = F.col("file_kind").isin(*PROSE_KINDS) | F.array_contains("pl", F.col("h.line"))
    defining = F.col("catalogue") | V.is_pattern_definition(F.col("h.snippet")) | F.array_contains("rl", F.col("h.line"))
    note = F.when(documented, "mentioned in prose").when(defining, "matches a pattern definition").otherwise("")
    return judged.withColumn("m", F.element_at(meta, F.col("h.i") + 1)).select(
        *keys, F.col("m.id").alias("id"), F.col("m.name").alias("name"), F.col("m.kind").alias("kind"),
        F.col("m.technology").alias("technology"), F.col("path").alias("file"), F.col("h.line").alias("line"),
        F.col("h.snippet").alias("snippet"), note.alias("note"),
    )


def established(hits: DataFrame, keys: Keys) -> DataFrame:
    """Systems with at least one real use, and the hits that count as their evidence."""
    ids = hits.where("note = ''")
    return ids


def systems_from_hits(hits: DataFrame, keys: Keys, max_evidence: int = 12) -> DataFrame:
    """One row per established system with the number of uses and the first evidence rows."""
    used = established(hits, keys)
    by = [*keys, "id", "name", "kind", "technology"]
    counts = used.groupBy(*by).agg(F.count(F.lit(1)).alias("uses"))
    item = F.struct("file", "line", "snippet", "note")
    listed = capped_list(used, by, ["file", "line"], item, max_evidence, "evidence")
    return counts.join(listed, by).withColumn("id", F.concat(F.lit("ext-"), "id"))


def hosts(files: DataFrame, keys: Keys, text: str = "text") -> DataFrame:
    """Outbound hosts of URLs in source, config and infra files, one row per occurrence."""
    found = find_lines(F.col(text), R.URL)
    hit = files.where(F.col("kind").isin("source", "config", "infra")).select(
        *keys, "path", F.explode(found).alias("f")
    ).select(*keys, F.col("path").alias("file"), F.col("f.line").alias("line"),
             F.col("f.text").alias("snippet"), F.explode("f.hits").alias("url"))
    host = F.lower(F.regexp_extract("url", R.URL, 1))
    return (
        hit.withColumn("host", host)
        .where(~F.col("host").rlike("(?i)" + R.LOCAL_HOST) & ~F.col("host").rlike("(?i)" + R.DOC_HOST))
        .where(~V.is_xml_namespace("snippet", F.col("url")))
        .select(*keys, "host", "file", "line", "snippet")
    )


def suppress_known_hosts(host_rows: DataFrame, system_ids: DataFrame, keys: Keys) -> DataFrame:
    """Drop hosts whose name contains the id of a detected system (ids of more than 3 letters).

    The ids of one repository are few (bounded by the signature table), so they come along
    as one small array per repository instead of a row-by-row comparison.
    """
    ids = (
        system_ids.where(F.length("id") > 3).groupBy(*keys).agg(F.collect_set("id").alias("ids"))
    )
    joined = host_rows.join(ids, keys, "left") if keys else host_rows.withColumn("ids", ids.select("ids").scalar())
    bare = F.replace(F.col("host"), F.lit("."), F.lit(""))
    covered = F.exists(F.coalesce("ids", F.expr("cast(array() as array<string>)")), lambda i: F.contains(bare, i) | F.contains(F.col("host"), i))
    return joined.where(~covered).drop("ids")


def host_systems(host_rows: DataFrame, keys: Keys, max_evidence: int = 6) -> DataFrame:
    by = [*keys, "host"]
    counts = host_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("uses"))
    item = F.struct("file", "line", "snippet", F.lit("").alias("note"))
    listed = capped_list(host_rows, by, ["file", "line"], item, max_evidence, "evidence")
    return counts.join(listed, by).select(
        *keys, F.concat(F.lit("ext-host-"), slug("host")).alias("id"), F.col("host").alias("name"), F.lit("api").alias("kind"),
        F.lit("HTTPS").alias("technology"), "uses", "evidence")


def env_vars(files: DataFrame, keys: Keys, max_files: int = 10) -> DataFrame:
    """Environment variables read by source, config and infra files: number of files and the first of them."""
    names = F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all("text", F.lit(R.ENV_READ), F.lit(g)) for g in range(1, 9)])))
    uses = (
        files.where(F.col("kind").isin("source", "config", "infra") & F.col("text").rlike(R.ENV_READ))
        .select(*keys, F.col("path").alias("file"), F.explode(names).alias("name"))
        .where((F.col("name") != "") & ~F.col("name").isin(*R.SHELL_NAMES))
    )
    total = uses.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n_files"))
    return capped_list(uses, [*keys, "name"], ["file"], F.col("file"), max_files, "files").join(total, [*keys, "name"]).withColumn("kind", env_kind("name"))


def merge_systems(code: DataFrame, infra: DataFrame, keys: Keys, extra: int = 3) -> DataFrame:
    """Code systems and infrastructure systems joined by name; infra adds its first evidence."""
    c = code.select(*keys, "name", F.struct("id", "kind", "technology", "evidence").alias("c"))
    i = infra.select(*keys, "name", F.struct("id", "kind", "technology", "evidence").alias("i"))
    both = c.join(i, [*keys, "name"], "full_outer")
    none = F.expr("cast(array() as array<struct<file:string,line:int,snippet:string,note:string>>)")
    return both.select(
        *keys, F.coalesce("c.id", "i.id").alias("id"), "name", F.coalesce("c.kind", "i.kind").alias("kind"),
        F.coalesce("c.technology", "i.technology").alias("technology"),
        F.when(F.col("c").isNull(), F.col("i.evidence")).otherwise(
            F.concat(F.col("c.evidence"), F.coalesce(F.slice("i.evidence", 1, extra), none))).alias("evidence"),
    )


def systems_by_file(uses: DataFrame, systems: DataFrame, keys: Keys) -> DataFrame:
    """Distinct (file, system) pairs from all uses ``(keys, id, file)`` of the given systems."""
    return uses.where("file <> ''").select(*keys, "file", "id").distinct().join(systems.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")


def with_apps(systems: DataFrame, uses: DataFrame, app_of_file: DataFrame, keys: Keys) -> DataFrame:
    """Apps of a system: apps of all files that use it, not only of the shown evidence."""
    apps = (
        uses.join(app_of_file.select(*keys, F.col("path").alias("file"), "app"), [*keys, "file"])
        .where("app <> ''").groupBy(*keys, "id").agg(F.array_sort(F.collect_set("app")).alias("apps"))
    )
    return systems.join(apps, [*keys, "id"], "left").withColumn(
        "apps", F.coalesce("apps", F.expr("cast(array() as array<string>)")))


def largest_systems(systems: DataFrame, keys: Keys, n: int = 10) -> DataFrame:
    return top_per_group(systems, keys, [F.desc("uses"), "id"], n)


def first_use(hits: DataFrame, keys: Keys) -> DataFrame:
    """Earliest real use of every system."""
    return first_wins(hits.where("note = ''"), [*keys, "id"], ["file", "line"])


