"""From raw files to the inventory: what to analyse, in what language, and what for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codecensus.functions import classify as C
from codecensus.functions.text import ancestors, basename, dirname, glob_regex, line_total
from codecensus.rules import files as R
from codecensus.session import broadcast_if_small

PROJECT_FILES = r"(?i)\.(csproj|fsproj|vbproj|sln)$"


def read_repositories(spark: SparkSession, parent: str) -> DataFrame:
    """Every file below ``parent/<repo>/...`` as ``(repo, path, size, content)``.

    Content is opened only where it is asked for; large files are judged, and counted, by ``tag_files``.
    """
    base = parent.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    inner = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    return raw.select(
        F.substring_index(inner, "/", 1).alias("repo"), F.regexp_replace(inner, "^[^/]*/", "").alias("path"),
        F.col("length").alias("size"), "content")


def decode(content: Column | str = "content") -> Column:
    """Text of a file: '' when a NUL byte shows it is binary, UTF-8 when valid, else Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.position(F.unhex(F.lit("00")), c) > 0, "").when(F.is_valid_utf8(c.cast("string")), F.decode(c, "UTF-8")).otherwise(F.decode(c, "ISO-8859-1"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of all ignore files: ``(repo, base, ord, pattern, negated, dir_only)``."""
    lines = F.posexplode(F.split("text", r"\r?\n"))
    text = F.col("text") if "text" in files.columns else decode("content")
    found = files.where(basename("path") == ".gitignore").select("repo", "path", text.alias("text"))
    raw = found.select("repo", dirname("path").alias("base"), lines.alias("ord", "raw"))
    line = F.btrim(F.col("raw"), F.lit(" \t\r\f"))
    named = raw.where((line != "") & ~line.startswith("#")).select(
        "repo", "base", "ord", line.startswith("!").alias("negated"), F.regexp_replace(line, "^!", "").alias("p"))
    return named.select(
        "repo", "base", "ord", F.rtrim("p", F.lit("/")).alias("pattern"), "negated", F.col("p").endswith("/").alias("dir_only")
    ).where("pattern <> ''")


def _rule_arrays(rules: DataFrame) -> DataFrame:
    """Rules of one ignore file as one array: their number is bounded by that file."""
    p = F.col("pattern")
    seg = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"([\\.^$+(){}|])", r"\\$1"), F.lit("[!"), F.lit("[^")), F.lit("*"), F.lit("\x01")), F.lit("?"), F.lit("."))
    glob = lambda c: F.replace(seg(c), F.lit("\x01"), F.lit(".*"))
    bare = F.regexp_replace(p, "^/", "")
    regex = (
        F.when(p.startswith("/"), F.concat(F.lit("(?s)^(?:"), glob(bare), F.lit(")$|^"), glob(F.rtrim(bare, F.lit("*"))), F.lit("/")))
        .when(p.contains("/"), F.concat(F.lit("(?s)^"), glob(p), F.lit("(?:/.*)?$")))
        .otherwise(F.concat(F.lit("(?:^|/)"), F.replace(seg(p), F.lit("\x01"), F.lit("[^/]*")), F.lit("(?:/|$)")))
    )
    shape = (
        F.when(~p.contains("/") & ~p.rlike(r"[*?\[]"), "name")
        .when(~p.contains("/") & p.rlike(r"^\*[^*?\[]+$"), "suffix").otherwise("regex")
    )
    rule = F.struct("ord", shape.alias("shape"), "pattern", regex.alias("regex"), "negated", (F.col("dir_only") & ~p.contains("/")).alias("dir_only"))
    return rules.groupBy("repo", "base").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths ``(repo, path)`` that the ignore rules drop.

    The last matching rule decides, for the file and for each of its directories; a
    dropped directory cannot be re-included below. Directories are judged once each, not
    once per file, and meet the rules through an equi-join on (repo, rule base).
    """
    dirs = paths.select("repo", F.explode(ancestors("path")).alias("target")).where("target <> ''").distinct().withColumn("is_dir", F.lit(True))
    targets = dirs.unionByName(paths.select("repo", F.col("path").alias("target"), F.lit(False).alias("is_dir")))
    arrays = _rule_arrays(rules)
    met = targets.select("repo", "target", "is_dir", F.explode(ancestors("target")).alias("base")).join(arrays, ["repo", "base"])
    rel = F.when(F.col("base") == "", F.col("target")).otherwise(F.expr("substring(target, length(base) + 2)"))
    segs = F.split(rel, "/")
    above = F.slice(segs, F.lit(1), F.size(segs) - 1)

    def applies(r: Column) -> Column:
        hit = (
            F.when(r["shape"] == "name", F.array_contains(segs, r["pattern"]))
            .when(r["shape"] == "suffix", F.exists(segs, lambda s: F.endswith(s, F.substr(r["pattern"], F.lit(2)))))
            .otherwise(F.rlike(rel, r["regex"]))
        )
        return hit & (~r["dir_only"] | F.col("is_dir") | F.array_contains(above, r["pattern"]))

    last = F.try_element_at(F.filter("rules", applies), F.lit(-1))
    verdict = (
        met.select("repo", "target", "is_dir", F.length("base").alias("depth"), last["negated"].alias("negated")).where("negated IS NOT NULL")
        .groupBy("repo", "target", "is_dir").agg(F.max_by("negated", "depth").alias("negated")).where("NOT negated")
    )
    bad_files = verdict.where("NOT is_dir").select("repo", F.col("target").alias("path"))
    bad_dirs = verdict.where("is_dir").select("repo", F.col("target").alias("dir"))
    below = (
        paths.select("repo", "path", F.explode(ancestors("path")).alias("dir")).where("dir <> ''")
        .join(bad_dirs, ["repo", "dir"], "left_semi").select("repo", "path")
    )
    return bad_files.unionByName(below).distinct()


def _first_index(segs: Column, test) -> Column:
    """1-based position of the first segment that passes, 0 without one."""
    return F.array_position(F.transform(segs, test), F.lit(True)).cast("int")


def _pruned_at() -> tuple[Column, Column, Column]:
    """Directories of a path, and where a vendor or an ignored one stands first."""
    segs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    vendor = _first_index(segs, lambda s: s.isin(*R.VENDOR_DIRS))
    hidden = _first_index(segs, lambda s: s.isin(*R.IGNORED_DIRS) | (s.startswith(".") & ~s.isin(*R.KEPT_DOT_DIRS)))
    return segs, vendor, hidden


def tag_files(raw: DataFrame, rules: DataFrame | None = None, extra_ignores=(), include_globs=(), max_file_size: int = 2_000_000) -> DataFrame:
    """``(repo, path, size, cause, prune)``: '' for files to analyse, else why a file is left out.

    ``prune`` is the directory that was cut off, for vendor and ignored directories. Only paths and sizes are read; no
    text takes part in the joins.
    """
    raw = raw.select("repo", "path", "size")
    segs, vendor, hidden = _pruned_at()
    slim = raw.select("repo", "path")
    # bin/ is build output where a project file or obj/ lies beside it.
    has_bin = slim.where(F.col("path").rlike("(^|/)bin/")).select("repo", "path", F.explode(ancestors("path")).alias("parent"))
    bin_parent = has_bin.where(F.expr("startswith(path, concat(CASE WHEN parent = '' THEN '' ELSE concat(parent, '/') END, 'bin/'))"))
    beside = (
        slim.where(basename("path").rlike(PROJECT_FILES)).select("repo", dirname("path").alias("parent"))
        .unionByName(slim.where(F.col("path").rlike("(^|/)obj/")).select("repo", F.regexp_replace("path", "(^|/)obj/.*$", "").alias("parent")))
        .distinct()
    )
    output = bin_parent.join(beside, ["repo", "parent"], "left_semi").groupBy("repo", "path").agg(F.min("parent").alias("__bin"))
    tagged = raw.join(output, ["repo", "path"], "left")
    first = F.least(
        F.when(vendor > 0, vendor), F.when(hidden > 0, hidden),
        F.when(F.col("__bin").isNotNull(), F.when(F.col("__bin") == "", 1).otherwise(F.size(F.split("__bin", "/")) + 1)))
    globs = [glob_regex(g) for g in (*R.IGNORED_GLOBS, *extra_ignores)]
    any_glob = "|".join(f"(?:{g[4:]})" for g in globs)
    name = basename("path")
    ignored_glob = name.rlike("(?s)" + any_glob) | F.col("path").rlike("(?s)" + any_glob)
    cause = (
        F.when(vendor == first, "vendored").when(first > 0, "ignored_dir")
    )
    if include_globs:
        wanted = "|".join(f"(?:{glob_regex(g)[4:]})" for g in include_globs)
        cause = cause.when(~F.col("path").rlike("(?s)" + wanted), "not_included")
    cause = cause.when(ignored_glob, "ignored_glob")
    tagged = tagged.withColumn("prune", F.when(first > 0, F.array_join(F.slice(segs, F.lit(1), first), "/")))
    tagged = tagged.withColumn("cause", F.coalesce(cause, F.lit(""))).drop("__bin")
    if rules is not None:
        bad = ignored_paths(tagged.where("cause = ''").select("repo", "path"), rules).withColumn("__bad", F.lit(True))
        tagged = tagged.join(bad, ["repo", "path"], "left").withColumn(
            "cause", F.when((F.col("cause") == "") & F.coalesce("__bad", F.lit(False)), "gitignore").otherwise(F.col("cause"))).drop("__bad")
    return tagged.withColumn("cause", F.when((F.col("cause") == "") & (F.col("size") > max_file_size), "large").otherwise(F.col("cause")))


def walk_stats(tagged: DataFrame) -> DataFrame:
    """Skip counters per repository."""
    pruned = F.col("prune").isNotNull()
    c = F.col("cause")
    return tagged.groupBy("repo").agg(
        F.count_if(~pruned).alias("total_seen"), F.count_if(c == "").alias("kept"),
        (F.count_if(c.isin("ignored_glob", "gitignore"))).alias("skipped_files"),
        F.countDistinct(F.when(c == "ignored_dir", F.col("prune"))).alias("skipped_dirs"),
        F.count_if(c == "large").alias("skipped_large"),
        F.countDistinct(F.when(c == "vendored", F.col("prune"))).alias("vendored"))


def vendor_dirs(tagged: DataFrame) -> DataFrame:
    return tagged.where("cause = 'vendored'").select("repo", F.col("prune").alias("dir")).distinct()


def inventory(raw: DataFrame, tagged: DataFrame, include_tests: bool = True) -> DataFrame:
    """Files to analyse with language, kind, line counts and text, from ``raw`` and its judgements.

    What a path alone decides is filtered in the row, so pruned folders are never decoded. The paths that need a look at
    other files (ignore files, build output) and those too large are taken out by their list, which is broadcast after a
    check of its size; only a longer list moves texts.
    """
    _, vendor, hidden = _pruned_at()
    open_paths = (vendor == 0) & (hidden == 0)
    out_list = tagged.where((F.col("cause") != "") & open_paths).select("repo", "path")
    kept = raw.where(open_paths).join(broadcast_if_small(out_list), ["repo", "path"], "left_anti")
    text = F.col("text") if "text" in raw.columns else decode("content")
    out = kept.select("repo", "path", "size", text.alias("text"), C.language("path").alias("language"))
    out = out.withColumn("kind", C.file_kind("path", "language"))
    if not include_tests:
        out = out.where("kind <> 'test'")
    return out.withColumn("loc", line_total("text")).withColumn("sloc", C.code_lines("path", "text"))
