"""Joins, ordered groups, reconciliation, roll-ups, reviews and documents on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecensus.operators import deps as D
from codecensus.operators import flows as FL
from codecensus.operators import group as GR
from codecensus.operators import models as MO
from codecensus.operators import report as RP
from codecensus.operators import resolve as RS
from codecensus.operators import review as RV
from codecensus.operators import security as SE
from codecensus.operators import windows as W
from codecensus.plans.registry import query, table
from codecensus.sinks import exports as X
from codecensus.sources import files as SF
from codecensus.sources import tables as T

KEYS = ["repo"]


def literal(spark, schema: str, rows):
    """A small constant table, built without a Python worker."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = [f.strip().split(" ")[1] for f in schema.split(",")]
    lit = lambda v, t: F.lit(v).cast(t)
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[lit(v, t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows])).alias("x")).select("x.*")


# ------------------------------------------------------------ ordered groups

@query("first_wins", """
SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2""")
def first_wins(spark, d):
    return W.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("forward_fill", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations""")
@query("forward_fill_texts", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations""")
def forward_fill(spark, d):
    c = table(spark, d, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("text")))
    return W.forward_fill(c.select("conv_id", "turn", "head"), ["conv_id"], "turn", "head", "section", chunk_rows=4).select("conv_id", "turn", "section")


@query("forward_fill_events", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS last_purchase FROM events""")
def forward_fill_events(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 2).alias("half"), "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return W.forward_fill(e, ["half"], "event_id", "v", "last_purchase", chunk_rows=1000).select("event_id", "last_purchase")


@query("top_per_group", "SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part QUALIFY rank <= 12")
def top_per_group(spark, d):
    return W.top_per_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 12, rank="rank")


@query("fold_other", """
WITH s AS (SELECT lang AS repo, source AS label, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, label) AS rn, count(*) OVER (PARTITION BY repo) AS c FROM s)
SELECT repo, label, n FROM r WHERE c <= 8 OR rn < 8 UNION ALL SELECT repo, 'Other (' || (max(c) - 7) || ')', sum(n)::BIGINT FROM r WHERE c > 8 AND rn >= 8 GROUP BY repo""")
def fold_other(spark, d):
    return W.fold_other(table(spark, d, "documents").select(F.col("lang").alias("repo"), F.col("source").alias("label"), F.col("n_chars").alias("n")), KEYS, "label", "n", 8).select("repo", "label", "n")


@query("overflow_labels", """
WITH s AS (SELECT DISTINCT lang AS repo, source AS label FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY label) AS rn, count(*) OVER (PARTITION BY repo) AS c FROM s)
SELECT repo, label FROM r WHERE rn <= 16 UNION ALL SELECT repo, '+' || (max(c) - 16) || ' more' FROM r WHERE c > 16 GROUP BY repo""")
def overflow_labels(spark, d):
    s = table(spark, d, "documents").select(F.col("lang").alias("repo"), F.col("source").alias("label")).distinct()
    return W.with_overflow(s, KEYS, "label", ["label"], 16).select("repo", "label")


@query("merge_smallest", """
WITH s AS (SELECT p_type AS repo, p_brand AS label, count(*)::BIGINT AS n FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, label) AS rn, count(*) OVER (PARTITION BY repo) AS c FROM s)
SELECT repo, label, n, 0::BIGINT AS merged FROM r WHERE c <= 10 OR rn < 10 UNION ALL SELECT repo, '(other)', sum(n)::BIGINT, max(c) - 9 FROM r WHERE c > 10 AND rn >= 10 GROUP BY repo""")
def merge_smallest(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_type").alias("repo"), F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return W.merge_smallest(s, KEYS, "label", "n", 10)


@query("point_lookups", """
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'error') AND user_id IN (1, 2, 3, 5, 8, 13)""")
def point_lookups(spark, d):
    return W.select_by(table(spark, d, "events"), event_type=["purchase", "error"], user_id=[1, 2, 3, 5, 8, 13]).select("event_id", "user_id", "event_type")


@query("merge_evidence", """
WITH o AS (SELECT event_type AS repo, user_id::VARCHAR AS file, floor(value / 5)::INT AS line, props AS snippet, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT repo, file, line, snippet, event_id FROM o QUALIFY row_number() OVER (PARTITION BY repo ORDER BY event_id) <= 8""")
def merge_evidence(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("repo"), F.col("user_id").cast("string").alias("file"), F.floor(F.col("value") / 5).cast("int").alias("line"), F.col("props").alias("snippet"), "event_id")
    return W.merge_evidence(e, KEYS, ["event_id"]).drop("rank")


@query("dedupe_findings", """
WITH f AS (SELECT event_id, event_type AS repo, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'u' || user_id END AS file, floor(value / 10)::INT AS line, 'K' || (event_id % 7) AS identifier, 'id' || (event_id % 400) AS id FROM events)
SELECT repo, file, line, identifier, id FROM f QUALIFY row_number() OVER (PARTITION BY repo, file, CASE WHEN file = '' THEN 0 ELSE line END, CASE WHEN file = '' THEN id ELSE identifier END ORDER BY event_id) = 1""")
def dedupe_findings(spark, d):
    u = F.col("user_id")
    f = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("repo"), F.when(u % 5 == 0, "").otherwise(F.concat(F.lit("u"), u)).alias("file"), F.floor(F.col("value") / 10).cast("int").alias("line"),
        F.concat(F.lit("K"), F.col("event_id") % 7).alias("identifier"), F.concat(F.lit("id"), F.col("event_id") % 400).alias("id"))
    return SE.dedupe_findings(f, KEYS, ["event_id"]).select("repo", "file", "line", "identifier", "id")


# --------------------------------------------------------------------- paths

IGNORE = [("", 0, "*.html", False, False), ("", 1, "/fr/", False, True), ("", 2, "en", False, True), ("", 3, "de/1*", False, False), ("", 4, "!de/12*", True, False), ("en", 0, "?", False, False), ("", 5, "*7", False, False)]


def url_paths(spark, d):
    p = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/$", "")
    return table(spark, d, "pages").select(F.lit("web").alias("repo"), F.concat_ws("/", p, F.concat(F.lit("p"), "page_id", F.lit(".txt"))).alias("path"))


URL_SQL = "u AS (SELECT trim(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/') || '/p' || page_id || '.txt' AS path FROM pages)"


@query("ignore_rules", f"""
WITH {URL_SQL}, v AS (SELECT ltrim(path, '/') AS path, string_split(ltrim(path, '/'), '/') AS s FROM u),
dirs AS (SELECT path, CASE WHEN len(s) > 1 THEN s[1] END AS d1, CASE WHEN len(s) > 2 THEN s[1] || '/' || s[2] END AS d2 FROM v)
SELECT path FROM dirs WHERE contains(path, '.html/') OR d1 = 'fr' OR d1 = 'en' OR regexp_matches(coalesce(d1, ''), '^.*7$') OR regexp_matches(coalesce(d2, ''), '/[^/]*7$')
  OR (d2 LIKE 'de/1%' AND NOT d2 LIKE 'de/12%')""")
def ignore_rules(spark, d):
    rules = literal(spark, "repo string, base string, ord int, pattern string, negated boolean, dir_only boolean", [
        ("web", b, o, p.lstrip("!").rstrip("/"), n, do) for b, o, p, n, do in IGNORE])
    return SF.ignored_paths(url_paths(spark, d).withColumn("path", F.regexp_replace("path", "^/", "")), rules).select("path")


@query("deepest_prefix", f"""
WITH {URL_SQL}, v AS (SELECT ltrim(path, '/') AS path FROM u), r AS (SELECT unnest(['', 'fr', 'en', 'de', 'en/1', 'de/12', 'es/3']) AS root)
SELECT path, arg_max(root, length(root)) AS root FROM v JOIN r ON root = '' OR starts_with(path, root || '/') GROUP BY path""")
def deepest_prefix(spark, d):
    roots = literal(spark, "repo string, root string", [("web", r) for r in ("", "fr", "en", "de", "en/1", "de/12", "es/3")])
    return GR.deepest_prefix(url_paths(spark, d).withColumn("path", F.regexp_replace("path", "^/", "")), roots, KEYS).select("path", "root")


@query("workspace_members", """
WITH d AS (SELECT DISTINCT lang || '/' || source || CASE WHEN doc_id % 3 = 0 THEN '/in' ELSE '' END AS dir FROM documents)
SELECT dir AS root FROM d WHERE regexp_matches(dir, '^en/src1[^/]*$') OR dir = 'fr/src2' OR regexp_matches(dir, '^de/[^/]*$')""")
def workspace_members(spark, d):
    dirs = table(spark, d, "documents").select(F.lit("r").alias("repo"), F.concat(F.col("lang"), F.lit("/"), "source", F.when(F.col("doc_id") % 3 == 0, "/in").otherwise("")).alias("dir")).distinct()
    m = literal(spark, "repo string, dir string", [("r", "")]).withColumn("workspaces", F.array(F.lit("en/src1*"), F.lit("./fr/src2"), F.lit("de/**")))
    return GR.workspace_members(m, dirs, KEYS).select("root")


@query("component_split", """
WITH RECURSIVE f AS (SELECT lang || '/' || source || '/' || doc_id % 7 AS dir FROM documents),
d AS (SELECT dir, count(*) AS n, string_split(dir, '/') AS s FROM f GROUP BY dir),
t AS (SELECT array_to_string(s[1:i], '/') AS prefix, i AS level, sum(n) AS total FROM (SELECT *, unnest(range(0, len(s) + 1)) AS i FROM d) GROUP BY 1, 2),
k AS (SELECT CASE WHEN level = 1 THEN '' ELSE array_to_string(string_split(prefix, '/')[1:level - 1], '/') END AS prefix, count(*) AS kids FROM t WHERE level > 0 GROUP BY 1),
n AS (SELECT t.*, coalesce(kids, 0) AS kids, greatest(6, least(60, (SELECT sum(n) FROM d) // 12)) AS target FROM t LEFT JOIN k USING (prefix)),
w(dir, level, key, depth, ended) AS (SELECT dir, -1, '', 0, false FROM d
  UNION ALL SELECT w.dir, w.level + 1, CASE WHEN ended THEN key ELSE n.prefix END, depth + CASE WHEN kids > 1 THEN 1 ELSE 0 END,
    ended OR depth >= 3 OR kids = 0 OR (total <= target AND NOT (depth = 0 AND total > 12))
  FROM w JOIN n ON n.level = w.level + 1 AND n.prefix = array_to_string(string_split(w.dir, '/')[1:n.level], '/'))
SELECT key AS path, sum(n)::BIGINT AS files FROM (SELECT dir, arg_max(key, level) AS key FROM w GROUP BY dir) JOIN d USING (dir) GROUP BY key""")
def component_split(spark, d):
    """Directory tree of all documents, split until every part is small."""
    f = table(spark, d, "documents").select(
        F.lit("r").alias("repo"), F.lit("a").alias("app"), F.lit("").alias("root"), F.concat_ws("/", "lang", "source", (F.col("doc_id") % 7).cast("string"), F.concat(F.lit("f"), "doc_id")).alias("path"))
    return GR.split_components(f, KEYS).groupBy("path").agg(F.sum("n").alias("files"))


@query("import_resolution", r"""
WITH f AS (SELECT p_partkey, p_brand AS repo, 'pkg' || (p_partkey % 50) || '/m' || p_partkey || '.py' AS path FROM part),
q AS (SELECT p_brand AS repo, 'pkg' || (p_partkey % 50) || '/m' || p_partkey || '.py' AS file, unnest(['pkg' || (p_partkey % 50) || '.m' || p_partkey || '.Thing', 'os.path', 'lib_' || replace(p_name, ' ', '_') || '.x', '.m' || (p_partkey + 50), '.none']) AS module FROM part)
SELECT q.repo, q.file, q.module, coalesce(CASE WHEN module LIKE 'pkg%' THEN file WHEN module LIKE '.m%' THEN g.path END, '') AS internal_file, CASE WHEN module LIKE 'lib%' THEN split_part(module, '.', 1) ELSE '' END AS external_package,
  module = 'os.path' AS stdlib, (module = '.none' OR (module LIKE '.m%' AND g.path IS NULL)) AS unresolved
FROM q LEFT JOIN f g ON g.repo = q.repo AND module LIKE '.m%' AND g.path = split_part(file, '/', 1) || '/' || module[2:] || '.py'""")
def import_resolution(spark, d):
    p = table(spark, d, "part")
    pkg = F.concat(F.lit("pkg"), F.col("p_partkey") % 50)
    path = F.concat(pkg, F.lit("/m"), "p_partkey", F.lit(".py"))
    f = p.select(F.col("p_brand").alias("repo"), path.alias("path"), F.lit("Python").alias("language"))
    mods = F.array(F.concat(pkg, F.lit(".m"), "p_partkey", F.lit(".Thing")), F.lit("os.path"), F.concat(F.lit("lib_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".x")),
                   F.concat(F.lit(".m"), F.col("p_partkey") + 50), F.lit(".none"))
    i = p.select(F.col("p_brand").alias("repo"), path.alias("file"), F.lit("Python").alias("language"), F.explode(mods).alias("module"), F.lit(1).alias("line"), F.lit("").alias("raw"))
    i = i.withColumn("relative", F.col("module").startswith("."))
    none = spark.createDataFrame([], "repo string, path string, dir string, ecosystem string, name string, module_path string")
    alias = spark.createDataFrame([], "repo string, path string, ord int, prefix string, target string")
    return RS.resolve(i, f, none, alias, KEYS).select("repo", "file", "module", "internal_file", "external_package", "stdlib", "unresolved")


@query("saved_model_rows", """
SELECT source AS repo, 'texts' AS section, doc_id AS id, text AS name, n_chars AS size, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || n_chars ELSE lang END AS tags FROM documents
UNION ALL SELECT p_brand, 'parts', p_partkey, p_name, p_size, '' FROM part""")
def saved_model_rows(spark, d):
    """Two sections of many repositories, saved as model lines and read again by the types found in them."""
    x = table(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("n_chars").alias("size"),
                                            F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.col("n_chars").cast("string"))).otherwise(F.array("lang")).alias("tags"))
    p = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.expr("cast(array() as array<string>)").alias("tags"))
    items = T.model_items(X.model_lines({"texts": x, "parts": p}, KEYS))
    both = [T.section_rows(items, n).withColumn("section", F.lit(n)) for n in ("texts", "parts")]
    cols = ["repo", "section", F.col("id").cast("long").alias("id"), "name", F.col("size").cast("long").alias("size"), F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags")]
    return both[0].select(*cols).unionByName(both[1].select(*cols))


@query("resolve_aliases", r"""
WITH f AS (SELECT p_brand AS repo, 'app/src/' || CASE WHEN p_partkey % 2 = 0 THEN 'lib/' ELSE '' END || 'm' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '/index.ts' ELSE '.tsx' END AS path, p_partkey AS k FROM part),
q AS (SELECT f.repo, f.path AS file, f.k, unnest(['@/m' || k, '@lib/m' || (k + 25), '~' || k, '@none/m' || k, '@/none' || k]) AS module FROM f),
a AS (SELECT q.*, CASE WHEN module LIKE '@lib/%' THEN 'app/src/lib/' || module[6:] WHEN module LIKE '@/%' THEN 'app/src/' || module[3:] END AS base FROM q)
SELECT a.repo, a.file, a.module, coalesce(t.path, '') AS internal_file, t.path IS NULL AS external
FROM a LEFT JOIN f t ON t.repo = a.repo AND t.path IN (a.base || '.tsx', a.base || '/index.ts')""")
def resolve_aliases(spark, d):
    """TypeScript modules named by aliases of their repository, a longer prefix before a shorter."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    path = F.concat(F.lit("app/src/"), F.when(k % 2 == 0, "lib/").otherwise(""), F.lit("m"), k, F.when(k % 3 == 0, "/index.ts").otherwise(".tsx"))
    f = p.select(F.col("p_brand").alias("repo"), path.alias("path"), F.lit("TypeScript").alias("language"))
    mods = F.array(F.concat(F.lit("@/m"), k), F.concat(F.lit("@lib/m"), k + 25), F.concat(F.lit("~"), k), F.concat(F.lit("@none/m"), k), F.concat(F.lit("@/none"), k))
    i = p.select(F.col("p_brand").alias("repo"), path.alias("file"), F.lit("TypeScript").alias("language"), F.explode(mods).alias("module"), F.lit(1).alias("line"), F.lit("").alias("raw"), F.lit(False).alias("relative"))
    none = spark.createDataFrame([], "repo string, path string, dir string, ecosystem string, name string, module_path string")
    pairs = F.array(*[F.struct(F.lit(a).alias("prefix"), F.lit(t).alias("target")) for a, t in (("@/", "app/src"), ("@lib/", "app/src/lib"), ("@", "nowhere"))])
    alias = f.select("repo").distinct().select("repo", F.lit("tsconfig.json").alias("path"), F.posexplode(pairs).alias("ord", "a")).select("repo", "path", "ord", "a.prefix", "a.target")
    return RS.resolve(i, f, none, alias, KEYS).select("repo", "file", "module", "internal_file", (F.col("internal_file") == "").alias("external"))


@query("resolve_pathlike", r"""
WITH f AS (SELECT p_brand AS repo, 'd' || p_partkey % 4 || '/inc/' || CASE WHEN p_partkey % 5 = 0 THEN 'same' ELSE 'h' || p_partkey END || '.h' AS path FROM part GROUP BY 1, 2),
q AS (SELECT p_brand AS repo, p_partkey AS k, unnest(['inc/h' || p_partkey || '.h', 'inc/same.h', 'h' || p_partkey, 'd' || p_partkey % 4 || '/inc/h' || p_partkey || '.h', './h' || (p_partkey + 25), 'none.h']) AS module FROM part),
c AS (SELECT DISTINCT repo, module, k % 4 AS site FROM q),
full_path AS (SELECT c.*, CASE WHEN module LIKE './%' THEN 'd' || site || '/inc/' || module[3:] ELSE module END || '.h' AS spelled, ltrim(module, './') AS bare FROM c),
near AS (SELECT p.repo, p.module, p.site, f.path FROM full_path p JOIN f ON f.repo = p.repo AND f.path = spelled),
tail AS (SELECT p.repo, p.module, p.site, min(f.path) AS path FROM full_path p JOIN f ON f.repo = p.repo AND (f.path LIKE '%/' || bare OR f.path LIKE '%/' || bare || '.h')
  GROUP BY ALL HAVING count(DISTINCT f.path) = 1)
SELECT q.repo, q.k, q.module, coalesce(n.path, t.path, '') AS internal_file FROM q
LEFT JOIN near n ON n.repo = q.repo AND n.module = q.module AND n.site = q.k % 4 LEFT JOIN tail t ON t.repo = q.repo AND t.module = q.module AND t.site = q.k % 4""")
def resolve_pathlike(spark, d):
    """C includes: by path, from the including file, and by a suffix that only one file of the repository has."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    path = F.concat(F.lit("d"), k % 4, F.lit("/inc/"), F.when(k % 5 == 0, "same").otherwise(F.concat(F.lit("h"), k)), F.lit(".h"))
    f = p.select(F.col("p_brand").alias("repo"), path.alias("path"), F.lit("C").alias("language")).distinct()
    mods = F.array(F.concat(F.lit("inc/h"), k, F.lit(".h")), F.lit("inc/same.h"), F.concat(F.lit("h"), k), F.concat(F.lit("d"), k % 4, F.lit("/inc/h"), k, F.lit(".h")), F.concat(F.lit("./h"), k + 25), F.lit("none.h"))
    i = p.select(F.col("p_brand").alias("repo"), F.concat(F.lit("d"), k % 4, F.lit("/inc/by.c")).alias("file"), F.lit("C").alias("language"), F.explode(mods).alias("module"), k.alias("line"), F.lit("").alias("raw"))
    i = i.withColumn("relative", F.col("module").startswith("."))
    none = spark.createDataFrame([], "repo string, path string, dir string, ecosystem string, name string, module_path string")
    alias = spark.createDataFrame([], "repo string, path string, ord int, prefix string, target string")
    return RS.resolve(i, f, none, alias, KEYS).select("repo", F.col("line").alias("k"), "module", "internal_file")


# -------------------------------------------------------------- dependencies

def _deps(spark, d):
    """All parts as declared packages, all lineitems as locked or used by their status.

    Some parts are locked, used or both under names that no part declares, so every join has matches and rows without.
    """
    p = table(spark, d, "part")
    li = table(spark, d, "lineitem").select("l_partkey", "l_linestatus")
    k = F.col("l_partkey")
    declared = p.select(
        F.lit("r").alias("repo"), F.concat("p_brand", F.lit("/package.json")).alias("declared_in"), F.col("p_partkey").cast("int").alias("ord"), F.concat(F.lit("pkg_"), "p_partkey").alias("name"),
        F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, F.concat(F.lit("^"), "p_size")).otherwise(F.col("p_size").cast("string")).alias("version"),
        F.lit("npm").alias("ecosystem"), F.when(F.col("p_size") % 10 == 0, "dev").otherwise("runtime").alias("scope"), F.lit(True).alias("direct"), F.lit("").alias("purl"))
    locked = li.where(F.col("l_linestatus") == "F").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("r").alias("repo"), F.lit("package-lock.json").alias("declared_in"), k.cast("int").alias("ord"), F.concat(F.when(k % 5 == 0, "sub_").otherwise("pkg_"), k).alias("name"),
        F.concat(F.lit("9."), "n").alias("version"), F.lit("npm").alias("ecosystem"), F.lit("runtime").alias("scope"), F.lit(False).alias("direct"), F.lit("").alias("purl"))
    named = F.concat(F.when(k % 7 == 0, "sub-").when(k % 11 == 0, "extra_").when(k % 3 == 0, "pkg_").otherwise("pkg-"), k)
    used = li.where(F.col("l_linestatus") != "F").groupBy(named.alias("name")).agg(F.count(F.lit(1)).alias("n_files"))
    usage = used.select(F.lit("r").alias("repo"), "name", F.lit("npm").alias("ecosystem"), "n_files", F.array(F.concat("name", F.lit(".js"))).alias("files"), F.array(F.lit("app")).alias("apps"))
    return declared, locked, usage


DEPS_SQL = """
dc AS (SELECT 'pkg_' || p_partkey AS name, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '^' || p_size ELSE p_size::VARCHAR END AS v, CASE WHEN p_size % 10 = 0 THEN 'dev' ELSE 'runtime' END AS scope, p_brand || '/package.json' AS f FROM part),
lk AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN 'sub_' ELSE 'pkg_' END || l_partkey AS name, '9.' || count(*) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_partkey),
us AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN 'sub-' WHEN l_partkey % 11 = 0 THEN 'extra_' WHEN l_partkey % 3 = 0 THEN 'pkg_' ELSE 'pkg-' END || l_partkey AS name, count(*) AS n FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1),
dep AS (SELECT coalesce(dc.name, lk.name) AS name, CASE WHEN dc.name IS NULL THEN lk.v WHEN lk.name IS NOT NULL AND (dc.v = '' OR dc.v LIKE '^%') THEN lk.v ELSE dc.v END AS version,
  coalesce(scope, 'runtime') AS scope, dc.name IS NOT NULL AS direct, coalesce(dc.f, 'package-lock.json') AS f FROM dc FULL OUTER JOIN lk ON dc.name = lk.name),
full_dep AS (SELECT dep.*, us.name IS NOT NULL AS used FROM dep LEFT JOIN us ON replace(us.name, '-', '_') = dep.name)"""


@query("reconcile", f"WITH {DEPS_SQL} SELECT name, version, scope, direct, used, array_to_string(list_filter([CASE WHEN direct AND NOT used THEN 'unused' END, CASE WHEN version = '' THEN 'unpinned' END], lambda x: x IS NOT NULL), ',') AS marks FROM full_dep")
@query("reconcile_all", f"WITH {DEPS_SQL} SELECT name, version, scope, direct, used, array_to_string(list_filter([CASE WHEN direct AND NOT used THEN 'unused' END, CASE WHEN version = '' THEN 'unpinned' END], lambda x: x IS NOT NULL), ',') AS marks FROM full_dep")
def reconcile(spark, d):
    return _reconciled(*_deps(spark, d))


def _reconciled(declared, locked, usage):
    deps = D.reconcile(declared, locked, KEYS)
    full = D.with_usage(deps, usage, D.match_usage(deps, usage, KEYS), KEYS)
    return full.select("name", "version", "scope", "direct", "used", F.array_join(D.flags(), ",").alias("marks"))


@query("undeclared", f"WITH {DEPS_SQL} SELECT name, n AS n_files FROM us WHERE replace(name, '-', '_') NOT IN (SELECT name FROM dep) AND name NOT LIKE '%7'")
@query("undeclared_all", f"WITH {DEPS_SQL} SELECT name, n AS n_files FROM us WHERE replace(name, '-', '_') NOT IN (SELECT name FROM dep) AND name NOT LIKE '%7'")
def undeclared(spark, d):
    return _undeclared(*_deps(spark, d))


def _undeclared(declared, locked, usage):
    deps = D.reconcile(declared, locked, KEYS)
    optional = usage.where(F.col("name").endswith("7")).select("repo", "name")
    return D.undeclared(usage, D.match_usage(deps, usage, KEYS), optional, KEYS).select("name", "n_files")


@query("dependency_findings", f"""
WITH {DEPS_SQL}
SELECT 'CC-DEP-NOLOCK' AS identifier, '' AS package, arg_min(f, name) AS file, 'low' AS severity FROM full_dep
UNION ALL SELECT 'CC-DEP-UNPINNED', name, f, 'low' FROM full_dep WHERE scope <> 'dev' AND version = ''
UNION ALL SELECT 'CC-DEP-UNUSED', name, f, 'info' FROM full_dep WHERE direct AND NOT used AND scope <> 'dev'
UNION ALL SELECT 'CC-DEP-MISSING', name, name || '.js', 'medium' FROM us WHERE replace(name, '-', '_') NOT IN (SELECT name FROM dep)""")
@query("dependency_findings_all", f"""
WITH {DEPS_SQL}
SELECT 'CC-DEP-NOLOCK' AS identifier, '' AS package, arg_min(f, name) AS file, 'low' AS severity FROM full_dep
UNION ALL SELECT 'CC-DEP-UNPINNED', name, f, 'low' FROM full_dep WHERE scope <> 'dev' AND version = ''
UNION ALL SELECT 'CC-DEP-UNUSED', name, f, 'info' FROM full_dep WHERE direct AND NOT used AND scope <> 'dev'
UNION ALL SELECT 'CC-DEP-MISSING', name, name || '.js', 'medium' FROM us WHERE replace(name, '-', '_') NOT IN (SELECT name FROM dep)""")
def dependency_findings(spark, d):
    return _dependency_findings(spark, *_deps(spark, d))


def _dependency_findings(spark, declared, locked, usage):
    deps = D.reconcile(declared, locked, KEYS)
    m = D.match_usage(deps, usage, KEYS)
    full = D.with_usage(deps, usage, m, KEYS)
    none = usage.select("repo", "name").where(F.lit(False))
    locks = literal(spark, "repo string, path string", [("r", "Cargo.lock")])
    out = D.hygiene_findings(full, locks, KEYS).unionByName(D.usage_findings(full, D.undeclared(usage, m, none, KEYS), KEYS))
    return out.select("identifier", "package", "file", "severity")


@query("advisories", """
WITH v AS (SELECT p_brand AS repo, replace(p_name, ' ', '-') AS name, p_size || '.' || (p_partkey % 10) || '.0' AS version, p_size FROM part),
a AS (SELECT replace(p_name, ' ', '-') AS name, max(p_size) AS top, 'ADV-' || min(p_partkey) AS id FROM part GROUP BY 1)
SELECT DISTINCT repo, v.name AS package, version, a.id AS identifier, 'critical' AS severity, (top - 5) || '.0.0' AS fixed_version FROM v JOIN a USING (name) WHERE p_size < top - 5 AND p_size >= 3""")
def advisories(spark, d):
    p = table(spark, d, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    deps = p.select(F.col("p_brand").alias("repo"), name.alias("name"), F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 10, F.lit(".0")).alias("version"), F.lit("npm").alias("ecosystem"), F.array(F.lit("package.json")).alias("declared_in"))
    none = F.expr("cast(array() as array<string>)")
    adv = p.groupBy(name.alias("package")).agg(F.max("p_size").alias("top"), F.min("p_partkey").alias("k")).select(
        F.concat(F.lit("ADV-"), "k").alias("id"), none.alias("aliases"), F.lit("npm").alias("ecosystem"), "package", none.alias("versions"),
        F.array(F.struct(F.lit("3.0").alias("introduced"), F.concat(F.col("top") - 5, F.lit(".0.0")).alias("fixed"))).alias("events"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("score"))).alias("severity"),
        F.lit("").alias("label"), F.lit("").alias("summary"), none.alias("cwe_ids"), none.alias("refs"))
    return D.advisory_findings(deps, adv, KEYS).select("repo", "package", "version", "identifier", "severity", "fixed_version")


@query("advisory_ranges", """
WITH v AS (SELECT p_brand AS repo, replace(p_name, ' ', '_') AS package, p_name, p_size % 5 AS a, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 3 END AS b, p_partkey % 5 AS k FROM part),
w AS (SELECT *, a || CASE k WHEN 0 THEN '' WHEN 1 THEN '.' || b WHEN 2 THEN '.' || b || '.0' WHEN 3 THEN '.' || b || '.0-rc1' ELSE '.' || b || '+build.7' END AS version, (10 * a + b) * 2 - (k = 3)::INT AS val FROM v),
x AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT DISTINCT repo, package, version, 'ADV-' || id AS identifier FROM w JOIN x USING (p_name)
WHERE id % 7 <> 0 AND val >= 20 AND CASE WHEN id % 2 = 0 THEN val < 60 ELSE val <= 62 END""")
def advisory_ranges(spark, d):
    """Ranges that end with a fix or with the last affected version, over versions of unequal length, pre-releases and builds.

    Names differ in case and dashes, and some advisories are withdrawn.
    """
    p = table(spark, d, "part")
    a, b, k = F.col("p_size") % 5, F.col("p_partkey") % 3, F.col("p_partkey") % 5
    version = F.concat(a, F.when(k == 0, "").when(k == 1, F.concat(F.lit("."), b)).when(k == 2, F.concat(F.lit("."), b, F.lit(".0"))).when(
        k == 3, F.concat(F.lit("."), b, F.lit(".0-rc1"))).otherwise(F.concat(F.lit("."), b, F.lit("+build.7"))))
    deps = p.select(F.col("p_brand").alias("repo"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"), version.alias("version"), F.lit("pypi").alias("ecosystem"),
                    F.array(F.lit("requirements.txt")).alias("declared_in"))
    none, null = F.expr("cast(array() as array<string>)"), F.lit(None).cast("string")
    event = lambda i, f, e: F.struct(i.alias("introduced"), f.alias("fixed"), e.alias("last_affected"))
    last = F.when(F.col("k") % 2 == 0, event(null, F.lit("3.0.0"), null)).otherwise(event(null, null, F.lit("3.1")))
    ranges = F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event(F.lit("1"), null, null), last).alias("events")))
    package = F.struct(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("name"), F.lit("PyPI").alias("ecosystem"))
    raw = p.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(
        F.concat(F.lit("ADV-"), "k").alias("id"), F.lit("").alias("summary"), F.lit("").alias("details"), none.alias("aliases"),
        F.expr("cast(array() as array<struct<type:string,score:string>>)").alias("severity"), F.array(F.struct(package.alias("package"), none.alias("versions"), ranges.alias("ranges"))).alias("affected"),
        F.expr("cast(array() as array<struct<type:string,url:string>>)").alias("references"), F.expr("named_struct('severity', '', 'cwe_ids', cast(array() as array<string>))").alias("database_specific"),
        F.when(F.col("k") % 7 == 0, "2024-01-01").alias("withdrawn"))
    return D.advisory_findings(deps, T.advisories(raw), KEYS).select("repo", "package", "version", "identifier")


# ------------------------------------------------------------------- history

@query("authors", """
WITH n AS (SELECT o_orderstatus AS repo, 'c' || (o_custkey % 97) AS author, count(*) AS commits FROM orders GROUP BY 1, 2)
SELECT repo, author, commits FROM n QUALIFY row_number() OVER (PARTITION BY repo ORDER BY commits DESC, author) <= 10""")
def authors(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey") % 97).alias("author"))
    return RP.authors(c, KEYS).select("repo", "author", "commits")


@query("commit_span", """
WITH c AS (SELECT o_orderstatus AS repo, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
SELECT repo, count(*) AS commits, count(DISTINCT o_custkey) AS contributors, strftime(arg_max(o_orderdate, rn), '%Y-%m-%d') AS first_commit, strftime(arg_min(o_orderdate, rn), '%Y-%m-%d') AS last_commit FROM c GROUP BY 1""")
def commit_span(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("ts"))
    return RP.commit_span(c, KEYS)


@query("hotspots", """
WITH c AS (SELECT l_returnflag AS repo, 'p' || l_partkey AS path, count(*) AS changes FROM lineitem GROUP BY 1, 2)
SELECT repo, path, changes, row_number() OVER (PARTITION BY repo ORDER BY changes DESC, path)::INT AS rank FROM c QUALIFY rank <= 25""")
def hotspots(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_orderkey").alias("ord"), F.concat(F.lit("p"), "l_partkey").alias("path"))
    return RP.hotspots(c, KEYS)


@query("churn_by_dir", """
WITH c AS (SELECT lang || '/' || source || '/d' || doc_id AS path, n_chars FROM documents UNION ALL SELECT lang || '/x', n_chars FROM documents)
SELECT CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS dir, sum(n_chars)::BIGINT AS changes FROM c GROUP BY 1""")
def churn_by_dir(spark, d):
    doc = table(spark, d, "documents")
    c = doc.select(F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), "doc_id")).alias("path"), F.col("n_chars").alias("changes")).unionByName(doc.select(F.concat("lang", F.lit("/x")).alias("path"), F.col("n_chars").alias("changes")))
    return RP.churn_by_dir(c, [])


# ------------------------------------------------------------------- reports

PROFILE_SQL = """
f AS (SELECT source AS repo, d.doc_id, n_chars AS loc, CASE WHEN lang = 'de' THEN 'docs' WHEN toxic = 1 THEN 'infra' WHEN quality = 1 THEN 'source' WHEN quality = 0 THEN 'test' ELSE 'docs' END AS kind FROM documents d LEFT JOIN labels USING (doc_id)),
m AS (SELECT repo, count(*) AS total, count(*) FILTER (kind = 'source') AS source_files, count(*) FILTER (kind = 'docs') AS doc_files, count(*) FILTER (kind = 'infra') AS infra_files, count(*) FILTER (kind = 'test') AS test_files, sum(loc)::BIGINT AS loc,
  round(count(*) FILTER (kind = 'test') / greatest(count(*) FILTER (kind = 'source'), 1), 3) AS test_ratio FROM f GROUP BY 1),
p AS (SELECT *, CASE WHEN source_files = 0 AND loc = 0 THEN 'empty' WHEN doc_files / total >= 0.55 AND source_files <= greatest(5, total * 0.1) THEN 'documentation' WHEN infra_files / total >= 0.4 AND source_files <= total * 0.25 THEN 'infrastructure'
  WHEN source_files % 3 > 1 THEN 'monorepo' WHEN source_files % 2 = 1 THEN 'library' WHEN test_files % 2 = 1 THEN 'service' ELSE 'mixed' END AS profile FROM m)"""


def _facts(spark, d):
    q = F.col("quality")
    kind = F.when(F.col("lang") == "de", "docs").when(F.col("toxic") == 1, "infra").when(q == 1, "source").when(q == 0, "test").otherwise("docs")
    f = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("source").alias("repo"), kind.alias("kind"), F.col("n_chars").alias("loc"), F.col("n_chars").alias("sloc"), F.lit("Text").alias("language"))
    m = RP.file_metrics(f, KEYS).withColumn("total", F.col("scanned_files"))
    s = F.col("source_files")
    return m.withColumn("apps", F.when(s % 3 > 1, 2).otherwise(1)).withColumn("app_kind", F.when(s % 2 == 1, "library").otherwise("application")).withColumn(
        "endpoints", F.when((F.col("test_files") % 2 == 1) & (s % 2 == 0), 4).otherwise(0)).withColumn("external_systems", F.lit(0))


@query("file_metrics", f"WITH {PROFILE_SQL} SELECT repo, total AS scanned_files, source_files, doc_files, infra_files, test_files, loc, test_ratio FROM m")
def file_metrics(spark, d):
    return _facts(spark, d).select("repo", "scanned_files", "source_files", "doc_files", "infra_files", "test_files", "loc", "test_ratio")


@query("profile", f"WITH {PROFILE_SQL} SELECT repo, profile, CASE profile WHEN 'documentation' THEN 0 WHEN 'library' THEN 6 WHEN 'monorepo' THEN 14 ELSE 10 END AS max_flows FROM p")
def profile(spark, d):
    return RP.profile(_facts(spark, d)).select("repo", "profile", "max_flows")


@query("artifact_decisions", f"""
WITH {PROFILE_SQL}, x AS (SELECT *, profile IN ('documentation', 'empty') AS docs, source_files % 3 > 1 AS multi, (test_files % 2 = 1 AND source_files % 2 = 0) AS ends FROM p)
SELECT repo, unnest(['application-landscape', 'archimate', 'bpmn', 'business-overview', 'c4-component', 'c4-container', 'c4-context', 'deck', 'dependencies-section', 'dependency-graph', 'dependency-layers', 'deployment', 'endpoints-section',
  'entity-relationship', 'external-systems', 'flows', 'infrastructure-section', 'pdf', 'quality-section', 'security-section', 'sequence', 'workbook']) AS artifact,
  unnest([multi, NOT docs AND multi, false, true, true, NOT docs AND (multi OR ends), NOT docs, NOT docs, false, false, false, infra_files > 2, ends, false, false, false, infra_files > 2, true, test_files > 0, true, false, ends]) AS include FROM x""")
def artifact_decisions(spark, d):
    f = RP.profile(_facts(spark, d))
    for name, v in (("components", 2), ("import_edges", 0), ("findings", 0), ("dependencies", 0), ("flows", 0), ("tables", 0)):
        f = f.withColumn(name, F.lit(v))
    f = f.withColumn("has_deployment", F.col("infra_files") > 2).withColumn("has_infra", F.col("infra_files") > 2)
    return RP.artifact_decisions(f, KEYS)


@query("language_totals", "SELECT source AS repo, lang AS language, sum(n_chars)::BIGINT AS loc, count(*) AS files FROM documents GROUP BY 1, 2")
def language_totals(spark, d):
    return RP.language_totals(table(spark, d, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("language"), F.col("n_chars").alias("loc")), KEYS)


def _endpoints(spark, d):
    """Orders as endpoints: priority names the subject, status the method."""
    m = F.when(F.col("o_orderstatus") == "F", "GET").when(F.col("o_orderstatus") == "O", "POST").otherwise("DELETE")
    subject = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""))
    return table(spark, d, "orders").select(
        F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("repo"), F.concat(F.lit("app"), F.col("o_custkey") % 3).alias("app"), F.lit("http").alias("kind"), m.alias("method"),
        F.concat_ws("/", F.lit(""), F.lit("api"), subject, F.lit("{id}")).alias("path"), F.concat(F.lit("h"), "o_orderkey").alias("handler"), F.concat(F.lit("f"), F.col("o_orderkey") % 9, F.lit(".py")).alias("file"),
        (F.col("o_orderkey") % 1000).cast("int").alias("line"))


EP_SQL = """e AS (SELECT 'n' || (o_custkey % 25) AS repo, 'app' || (o_custkey % 3) AS app, CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'DELETE' END AS method,
  lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS s, o_orderkey FROM orders)"""


@query("capabilities", f"""
WITH {EP_SQL}, c AS (SELECT repo, s, count(*) AS n, bool_or(method = 'GET') AS g, bool_or(method = 'POST') AS p, bool_or(method = 'DELETE') AS x FROM e GROUP BY 1, 2),
v AS (SELECT *, list_filter([CASE WHEN g THEN 'look up' END, CASE WHEN p THEN 'create' END, CASE WHEN x THEN 'remove' END], lambda a: a IS NOT NULL) AS verbs FROM c),
t AS (SELECT repo, n, upper(s[1]) || s[2:] AS title, array_to_string(verbs, ', ') || ': ' || s AS plain FROM v)
SELECT repo, title, plain, n || CASE WHEN n = 1 THEN ' endpoint' ELSE ' endpoints' END AS detail, row_number() OVER (PARTITION BY repo ORDER BY n DESC, title)::INT AS ord FROM t""")
def capabilities(spark, d):
    return RP.capabilities(_endpoints(spark, d), KEYS).select("repo", "title", "plain", "detail", "ord")


@query("endpoint_groups", f"""
WITH {EP_SQL}, g AS (SELECT repo, app, s AS grp, count(*) AS size FROM e GROUP BY 1, 2, 3)
SELECT repo, app, grp, size, row_number() OVER (PARTITION BY repo, app ORDER BY size DESC, grp)::INT AS rank FROM g QUALIFY rank <= 8""")
def endpoint_groups(spark, d):
    return FL.endpoint_groups(_endpoints(spark, d), KEYS).select("repo", "app", "grp", "size", "rank")


@query("domain_nouns", f"""
WITH {EP_SQL}, w AS (SELECT repo, CASE WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END AS noun, 3 * count(*) AS weight FROM e GROUP BY 1, 2)
SELECT repo, noun, weight::BIGINT AS weight, row_number() OVER (PARTITION BY repo ORDER BY weight DESC, noun)::INT AS rank FROM w QUALIFY rank <= 6""")
def domain_nouns(spark, d):
    none = spark.createDataFrame([], "repo string, name string, kind string")
    return GR.domain_nouns(_endpoints(spark, d).withColumn("handler", F.lit("")), none, KEYS)


@query("endpoint_rollup", f"WITH {EP_SQL} SELECT repo, app, 'http' AS kind, count(*) AS endpoints FROM e GROUP BY 1, 2")
def endpoint_rollup(spark, d):
    return RP.endpoint_rollup(_endpoints(spark, d), KEYS)


@query("suggestions", f"""
WITH {PROFILE_SQL}, s AS (SELECT repo, list_filter([CASE WHEN source_files > 8 THEN 'Order of work for ' || source_files || ' severe findings' END,
  CASE WHEN test_files = 0 THEN 'First tests' END, CASE WHEN source_files % 3 > 1 THEN 'Applications to split off' END,
  CASE WHEN test_files % 2 = 1 AND source_files % 2 = 0 THEN 'Endpoints out of pattern' END, 'Introduction', 'Next steps'], lambda x: x IS NOT NULL) AS qs FROM p)
SELECT repo, unnest(qs) AS question, generate_subscripts(qs, 1)::INT AS ord FROM s""")
def suggestions(spark, d):
    f = _facts(spark, d).withColumn("severe", F.when(F.col("source_files") > 8, F.col("source_files")).otherwise(0)).withColumn("cycles", F.lit(0))
    for name in ("capability", "shared_system", "store", "top_component"):
        f = f.withColumn(name, F.lit(""))
    return RP.suggestions(f, KEYS)


@query("summary_rows", "WITH m AS (SELECT source AS repo, count(*) AS files, sum(n_chars)::BIGINT AS loc FROM documents GROUP BY 1) SELECT repo, unnest([1, 2]) AS ord, unnest(['Files', 'Lines']) AS metric, unnest([files::VARCHAR, loc::VARCHAR]) AS value FROM m")
def summary_rows(spark, d):
    m = table(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("loc"))
    return X.metric_rows(m, KEYS, [("Files", "files"), ("Lines", "loc")])


@query("worst_findings", """
SELECT user_id AS repo, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_type, event_id)::INT AS rank FROM events WHERE event_type IN ('purchase', 'error') QUALIFY rank <= 6""")
def worst_findings(spark, d):
    t = F.col("event_type")
    f = table(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("id"), F.when(t == "purchase", "critical").when(t == "error", "high").otherwise("low").alias("severity"), t.alias("category"), F.lit("").alias("file"), F.lit(0).alias("line"))
    return RP.worst_findings(f, KEYS).select("repo", "id", "rank")


# -------------------------------------------------------------------- models

@query("c4_containers", """
SELECT n_name AS repo, 'app' || c_custkey AS id, 'container' AS level, 'sys-' || lower(regexp_replace(n_name, '[^a-zA-Z0-9]+', '-', 'g')) AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT n_name, 'sys-' || lower(regexp_replace(n_name, '[^a-zA-Z0-9]+', '-', 'g')), 'system', '' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT n_name, 'person-user', 'person', '' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def c4_containers(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("repo"))
    none = F.expr("cast(array() as array<string>)")
    apps = table(spark, d, "customer").join(n, "c_nationkey").select(
        "repo", F.concat(F.lit("app"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("service").alias("kind"), none.alias("languages"), none.alias("frameworks"), F.lit("").alias("description"), F.lit(1).alias("files"))
    comps = spark.createDataFrame([], "repo string, id string, name string, app string, kind string, languages array<string>, files long, description string")
    systems = spark.createDataFrame([], "repo string, id string, name string, kind string, technology string")
    ep = spark.createDataFrame([], "repo string, kind string, method string")
    return MO.c4_elements(apps, comps, systems, ep, KEYS).select("repo", "id", "level", "parent")


@query("edge_names", """
SELECT l_orderkey, l_linenumber, coalesce(s_name, 's' || l_suppkey) AS source_name, CASE WHEN p_size <= 25 THEN p_name ELSE 'p' || l_partkey END AS target_name
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""")
def edge_names(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    names = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(
        table(spark, d, "part").where("p_size <= 25").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name")))
    return X.edge_names(e, names, []).select("l_orderkey", "l_linenumber", "source_name", "target_name")


# -------------------------------------------------------------------- review

@query("review_merge", """
WITH a AS (SELECT doc_id + (CASE WHEN toxic = 1 THEN 10000000 ELSE 0 END) AS id, CASE quality WHEN 1 THEN ' True_Positive' ELSE CASE WHEN doc_id % 2 = 0 THEN 'false_positive' ELSE 'maybe' END END AS assessment, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'because ' || doc_id END AS reasoning FROM labels),
j AS (SELECT a.*, d.doc_id IS NOT NULL AS known FROM a LEFT JOIN documents d ON d.doc_id = a.id)
SELECT 'd' || id AS id, CASE WHEN NOT known THEN 'finding id ''d' || id || ''' does not exist in this scan' WHEN lower(trim(assessment)) = 'maybe' THEN 'finding ''d' || id || ''' had assessment ''maybe''' WHEN reasoning = '' THEN 'finding ''d' || id || ''' was assessed without reasoning'
  ELSE lower(trim(assessment)) END AS outcome FROM j""")
def review_merge(spark, d):
    q = F.col("quality")
    a = table(spark, d, "labels").select(
        F.lit("r").alias("repo"), F.concat(F.lit("d"), F.col("doc_id") + F.when(F.col("toxic") == 1, 10000000).otherwise(0)).alias("id"),
        F.when(q == 1, " True_Positive").when(F.col("doc_id") % 2 == 0, "false_positive").otherwise("maybe").alias("assessment"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("because "), "doc_id")).alias("reasoning"))
    known = table(spark, d, "documents").select(F.lit("r").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("id"))
    ok, bad = RV.judge_findings(a, known, KEYS)
    return ok.select("id", F.col("assessment").alias("outcome")).unionByName(bad.select("id", F.col("reason").alias("outcome")))


@query("review_insights", """
WITH a AS (SELECT conv_id * 100 + turn AS ord, CASE role WHEN 'user' THEN 'risk' ELSE 'Answer' END AS kind, ['d' || conv_id, 'nope'] AS targets, CASE WHEN turn % 2 = 0 THEN ['a.py:' || (turn + 1)] ELSE ['no citation here'] END AS ev FROM conversations),
j AS (SELECT a.*, d.doc_id IS NOT NULL AS known FROM a LEFT JOIN documents d ON 'd' || d.doc_id = a.targets[1])
SELECT ord, lower(kind) AS kind, CASE WHEN known THEN targets[1] ELSE '' END AS targets, CASE WHEN ev[1] LIKE 'a.py%' THEN ev[1] ELSE '' END AS evidence FROM j WHERE NOT (kind = 'risk' AND ev[1] NOT LIKE 'a.py%')""")
def review_insights(spark, d):
    ord_ = F.col("conv_id") * 100 + F.col("turn")
    a = table(spark, d, "conversations").select(
        F.lit("r").alias("repo"), ord_.alias("ord"), F.lit("").alias("id"), F.when(F.col("role") == "user", "risk").otherwise("Answer").alias("kind"), F.concat(F.lit("t"), ord_).alias("title"), F.lit("").alias("detail"), F.lit("odd").alias("severity"),
        F.lit("").alias("confidence"), F.array(F.concat(F.lit("d"), "conv_id"), F.lit("nope")).alias("targets"), F.array(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("a.py:"), F.col("turn") + 1)).otherwise("no citation here")).alias("evidence"))
    ids = table(spark, d, "documents").select(F.lit("r").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("id"))
    ok, _ = RV.judge_insights(a, ids, KEYS)
    return ok.select("ord", "kind", F.array_join("targets", " ").alias("targets"), F.array_join("evidence", " ").alias("evidence"))


# ----------------------------------------------------------------- documents

def _bom(spark, d):
    none = F.expr("cast(array() as array<string>)")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("repo"), F.concat_ws("-", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), "p_partkey").alias("name"), F.col("p_size").cast("string").alias("version"), F.lit("npm").alias("ecosystem"), F.lit("runtime").alias("scope"),
        none.alias("declared_in"), F.lit(True).alias("direct"), F.lit(True).alias("declared"), F.lit(False).alias("used"), F.lit("").alias("purl"), F.lit("").alias("license"))


@query("spdx_numbers", """
WITH p AS (SELECT p_brand AS repo, replace(p_name, ' ', '-') || '-' || p_partkey AS name FROM part)
SELECT repo, name, 'SPDXRef-Package-' || (row_number() OVER (PARTITION BY repo ORDER BY lower(name), name) - 1) AS spdx_id FROM p""")
def spdx_numbers(spark, d):
    return X.spdx_packages(_bom(spark, d), KEYS).select("repo", F.col("package.name").alias("name"), "spdx_id")


@query("cyclonedx")
def cyclonedx(spark, d):
    """Bill-of-materials document lines of every brand."""
    deps = _bom(spark, d)
    none = spark.createDataFrame([], "repo string, category string, identifier string, package string, id string, title string, severity string, cwe string, remediation string, references array<string>")
    return X.cyclonedx(deps, none, deps.select("repo").distinct(), KEYS, "2024-01-01")


@query("spdx")
def spdx(spark, d):
    deps = _bom(spark, d)
    return X.spdx(deps, deps.select("repo").distinct(), KEYS, "2024-01-01")


@query("bom_refs", "SELECT p_partkey, 'pkg:generic/' || p_name || '@' || p_size AS ref, substr(sha1(p_name), 1, 8) || '-' || substr(sha1(p_name), 9, 4) || '-' || substr(sha1(p_name), 13, 4) || '-' || substr(sha1(p_name), 17, 4) || '-' || substr(sha1(p_name), 21, 12) AS uuid FROM part")
def bom_refs(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.lit("").alias("purl"))
    return p.select("p_partkey", X.package_ref().alias("ref"), X.stable_uuid(F.col("name")).alias("uuid"))


@query("model_lines", "SELECT source AS repo, 'files' AS section, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, 'labels', count(*) FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def model_lines(spark, d):
    doc = table(spark, d, "documents")
    t = {"files": doc.select(F.col("source").alias("repo"), "doc_id", "lang", "n_chars"), "labels": doc.join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("repo"), "doc_id", "quality", "toxic")}
    lines = X.model_lines(t, KEYS)
    return lines.where(F.get_json_object("json", "$.doc_id").isNotNull()).groupBy("repo", "section").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- flows, systems, tops

@query("flow_edges", """
WITH e AS (SELECT 'n' || (o_custkey % 25) AS repo, 'app' || (o_custkey % 3) AS app, CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'DELETE' END AS method,
  lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS s, 'f' || (o_orderkey % 9) || '.py' AS file, (o_orderkey % 1000)::INT AS line FROM orders),
g AS (SELECT repo, app, s, method FROM e QUALIFY row_number() OVER (PARTITION BY repo, app, s ORDER BY file, line, '/api/' || s, method) = 1),
k AS (SELECT repo, 'flow-' || app || '-http-' || s AS flow, method <> 'GET' AS writes FROM g)
SELECT repo, flow, 'start' AS source, 'entry' AS target, '' AS label, 'sequence' AS kind FROM k
UNION ALL SELECT repo, flow, 'entry', 'end', '', 'sequence' FROM k WHERE NOT writes
UNION ALL SELECT repo, flow, unnest(['entry', 'd0', 'd0']), unnest(['d0', 'd0-no', 'end']), unnest(['', 'no', 'yes']), unnest(['sequence', 'conditional', 'sequence']) FROM k WHERE writes""")
def flow_edges(spark, d):
    empty = lambda schema: spark.createDataFrame([], schema)
    _, _, edges = FL.build_flows(
        _endpoints(spark, d), empty("repo string, source string, target string"), empty("repo string, path string, app string"), empty("repo string, file string, id string"),
        empty("repo string, id string, name string, kind string"), empty("repo string, path string, text string"), empty("repo string, id string, name string"), KEYS)
    return edges.select("repo", "flow", "source", "target", "label", "kind")


@query("merge_systems", """
WITH c AS (SELECT p_brand AS repo, p_name AS name, 'c' || min(p_partkey) AS id FROM part WHERE p_size <= 20 GROUP BY 1, 2), i AS (SELECT p_brand AS repo, p_name AS name, 'i' || min(p_partkey) AS id, count(*) AS n FROM part WHERE p_size > 15 GROUP BY 1, 2)
SELECT coalesce(c.repo, i.repo) AS repo, coalesce(c.name, i.name) AS name, coalesce(c.id, i.id) AS id, CASE WHEN c.id IS NULL THEN i.n ELSE 1 + least(coalesce(i.n, 0), 3) END AS evidence FROM c FULL OUTER JOIN i ON c.repo = i.repo AND c.name = i.name""")
def merge_systems(spark, d):
    from codecensus.operators import systems as S

    p = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("name"), "p_partkey", "p_size")
    ev = F.struct(F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("").alias("snippet"), F.lit("").alias("note"))
    one = lambda df, prefix, arr: df.groupBy("repo", "name").agg(F.concat(F.lit(prefix), F.min("p_partkey")).alias("id"), F.count(F.lit(1)).alias("n")).select(
        "repo", "name", "id", F.lit("api").alias("kind"), F.lit("x").alias("technology"), arr.alias("evidence"))
    code = one(p.where("p_size <= 20"), "c", F.array(ev))
    infra = one(p.where("p_size > 15"), "i", F.array_repeat(ev, F.col("n").cast("int")))
    return S.merge_systems(code, infra, KEYS).select("repo", "name", "id", F.size("evidence").alias("evidence"))


@query("top_components", """
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem), i AS (SELECT target AS id, count(*) AS fan_in FROM e GROUP BY 1)
SELECT p_brand AS repo, 'p' || p_partkey AS id, p_retailprice AS rank, coalesce(fan_in, 0) AS fan_in, 0 AS fan_out, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, 'p' || p_partkey)::INT AS place
FROM part LEFT JOIN i ON i.id = 'p' || p_partkey QUALIFY place <= 10""")
def top_components(spark, d):
    from codecensus.operators import graph as G

    p = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("a").alias("app"), F.col("p_size").alias("files"), F.col("p_size").alias("loc"), "p_retailprice")
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    fans = G.fan(e, []).join(p.select("repo", F.col("id").alias("node")), "node")
    ranks = p.select("repo", F.col("id").alias("node"), F.col("p_retailprice").alias("rank"))
    return RP.top_components(p.drop("p_retailprice"), ranks, fans, KEYS).select("repo", "id", "rank", "fan_in", "fan_out", "place")


@query("dependency_rollup", "SELECT p_brand AS repo, p_type AS ecosystem, count(*) AS total, count(*) FILTER (p_size > 20) AS direct FROM part GROUP BY 1, 2")
def dependency_rollup(spark, d):
    return RP.dependency_rollup(table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("ecosystem"), (F.col("p_size") > 20).alias("direct")), KEYS)


@query("largest_files", "SELECT source AS repo, 'd' || doc_id AS path, n_chars AS loc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, 'd' || doc_id)::INT AS rank FROM documents QUALIFY rank <= 25")
def largest_files(spark, d):
    return RP.largest_files(table(spark, d, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("path"), F.col("n_chars").alias("loc")), KEYS)


@query("graph_links", """
WITH sz AS (SELECT p_brand AS repo, 'p' || p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, 'p' || p_partkey) AS rn FROM part), s AS (SELECT repo, id FROM sz WHERE rn <= 20),
e AS (SELECT a.p_brand AS repo, 'p' || a.p_partkey AS source, 'p' || b.p_partkey AS target FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 AND a.p_brand = b.p_brand)
SELECT repo, source, target, 1::BIGINT AS weight FROM e WHERE (repo, source) IN (SELECT repo, id FROM s) AND (repo, target) IN (SELECT repo, id FROM s)""")
def graph_links(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("a").alias("app"), F.col("p_size").alias("files"), "p_partkey")
    half = p.select("repo", F.col("p_partkey").alias("h"), F.col("id").alias("target"))
    e = p.withColumn("h", F.floor(F.col("p_partkey") / 2)).join(half, ["repo", "h"]).select("repo", F.col("id").alias("source"), "target", F.lit("imports").alias("kind"), F.lit(1).cast("long").alias("weight"))
    none = spark.createDataFrame([], "repo string, id string, name string, kind string, evidence array<string>")
    return X.graph_payload(p.drop("p_partkey"), none, e, KEYS, max_nodes=20)[1]
