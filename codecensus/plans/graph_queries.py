"""Graph operators on trade links (supplier nation -> customer nation) and part numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codecensus.operators import graph as G
from codecensus.operators.windows import top_per_group
from codecensus.plans.registry import query, table
from codecensus.session import cut

TRADE_SQL = """
trade AS (
  SELECT o_orderstatus AS repo, 's' || l_suppkey AS source, 'c' || o_custkey AS target, count(*)::BIGINT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
place AS (
  SELECT 's' || s_suppkey AS node, n_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'c' || c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
lifted AS (
  SELECT t.repo, a.grp AS source, b.grp AS target, sum(weight)::BIGINT AS weight
  FROM trade t JOIN place a ON t.source = a.node JOIN place b ON t.target = b.node
  WHERE a.grp <> b.grp GROUP BY 1, 2, 3)"""

PART_SQL = """
links AS (
  SELECT DISTINCT source, target FROM (
    SELECT p_partkey AS source, p_partkey // 10 AS target FROM part
    UNION ALL SELECT p_partkey, p_partkey // 7 + 1 FROM part WHERE p_partkey > 7)
  WHERE source <> target)"""

RING_SQL = """
links AS (
  SELECT DISTINCT source, target FROM (
    SELECT c_custkey AS source, (c_custkey // 10) * 10 + (c_custkey + 3) % 10 AS target FROM customer
    UNION ALL SELECT c_custkey, c_custkey // 10 FROM customer)
  WHERE source <> target AND target IN (SELECT c_custkey FROM customer))"""


def trade_edges(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("repo"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "repo", F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"),
        F.lit("imports").alias("kind"), F.lit(1).cast("long").alias("weight"),
    )


def trade_places(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("group"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("n_nationkey"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("n_nationkey"))
    return s.unionByName(c).join(n, "n_nationkey").select("node", "group")


def lifted_trade(spark, d) -> DataFrame:
    """Trade edges lifted to nations. Places are the same for every repo, so they join by node."""
    pre = trade_edges(spark, d).groupBy("repo", "source", "target").agg(F.sum("weight").alias("weight"))
    place = trade_places(spark, d)
    src = place.select(F.col("node").alias("source"), F.col("group").alias("gs"))
    dst = place.select(F.col("node").alias("target"), F.col("group").alias("gt"))
    return (
        pre.join(src, "source").join(dst, "target").where("gs <> gt")
        .groupBy("repo", F.col("gs").alias("source"), F.col("gt").alias("target")).agg(F.sum("weight").alias("weight"))
    )


def part_links(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey")
    a = p.select(k.alias("source"), F.floor(k / 10).alias("target"))
    b = p.where(k > 7).select(k.alias("source"), (F.floor(k / 7) + 1).alias("target"))
    return a.unionByName(b).where("source <> target").distinct().withColumn("weight", F.lit(1).cast("long"))


def ring_links(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey")
    a = c.select(k.alias("source"), (F.floor(k / 10) * 10 + (k + 3) % 10).alias("target"))
    b = c.select(k.alias("source"), F.floor(k / 10).alias("target"))
    return a.unionByName(b).where("source <> target").distinct().join(
        c.select(k.alias("target")), "target", "left_semi").select("source", "target")


@query("edge_dedupe", """
WITH e AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS kind,
                  l_orderkey * 10 + l_linenumber AS ev FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY ev) AS rn FROM e)
SELECT source, target, kind, count(*)::BIGINT AS weight,
       string_agg(CASE WHEN rn <= 8 THEN ev::VARCHAR END, ';' ORDER BY ev) AS evidence
FROM r GROUP BY 1, 2, 3""")
def edge_dedupe(spark, d):
    e = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"),
        F.col("l_returnflag").alias("kind"), F.lit(1).cast("long").alias("weight"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence"))
    out = G.dedupe_edges(e, [], evidence_order="evidence")
    return out.withColumn("evidence", F.concat_ws(";", F.col("evidence").cast("array<string>")))


@query("edge_lift", f"WITH {TRADE_SQL} SELECT * FROM lifted")
def edge_lift(spark, d):
    return lifted_trade(spark, d)


@query("edge_lift_mapping", """
WITH e AS (SELECT l_suppkey AS s, l_partkey AS t, count(*) AS w FROM lineitem GROUP BY 1, 2)
SELECT a.s_nationkey::VARCHAR AS source, p_brand AS target, 'depends' AS kind, sum(w)::BIGINT AS weight
FROM e JOIN supplier a ON s = a.s_suppkey JOIN part ON t = p_partkey GROUP BY 1, 2""")
def edge_lift_mapping(spark, d):
    e = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"),
        F.lit(1).cast("long").alias("weight"))
    m = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").cast("string").alias("group")
    ).unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("group")))
    return G.lift_edges(e, m, [], kind="depends")


@query("fan_instability", f"""
WITH {TRADE_SQL}, f AS (
  SELECT repo, node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (
    SELECT repo, source AS node, 0 AS i, 1 AS o FROM lifted UNION ALL SELECT repo, target, 1, 0 FROM lifted) GROUP BY 1, 2)
SELECT *, round(fan_out / (fan_in + fan_out), 3) AS instability FROM f""")
def fan_instability(spark, d):
    return G.instability(G.fan(lifted_trade(spark, d), ["repo"]))


@query("orphan_parts", """
SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey - l_partkey % 3 FROM lineitem)""")
@query("orphan_parts_all", """
SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey - l_partkey % 3 FROM lineitem)""")
def orphan_parts(spark, d):
    """Edges of all lineitems, each to the first of three neighbouring parts."""
    e = table(spark, d, "lineitem").select((-F.col("l_suppkey").cast("long") - 1).alias("source"), (F.col("l_partkey") - F.col("l_partkey") % 3).alias("target"))
    return G.orphans(table(spark, d, "part").select(F.col("p_partkey").alias("node")), e, [])


@query("neighbour_pairs", f"WITH {TRADE_SQL} SELECT DISTINCT repo, source, target FROM trade")
def neighbour_pairs(spark, d):
    return G.neighbours(trade_edges(spark, d), ["repo"])


@query("graph_layers", f"""
WITH RECURSIVE {PART_SQL}, nodes AS (SELECT source AS node FROM links UNION SELECT target FROM links),
walk(node, depth) AS (
  SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT source FROM links)
  UNION SELECT l.source, w.depth + 1 FROM walk w JOIN links l ON l.target = w.node)
SELECT node, max(depth)::INT AS layer FROM walk GROUP BY 1""")
def graph_layers(spark, d):
    links = part_links(spark, d)
    return G.layers(G.endpoints_of(links, []), links, [])


@query("graph_reachable", f"""
WITH RECURSIVE {PART_SQL}, walk(start, node, depth) AS (
  SELECT source, target, 1 FROM links
  UNION SELECT w.start, l.target, w.depth + 1 FROM walk w JOIN links l ON l.source = w.node WHERE w.depth < 4)
SELECT start, node, min(depth)::INT AS depth FROM walk WHERE start <> node GROUP BY 1, 2""")
def graph_reachable(spark, d):
    links = part_links(spark, d)
    return G.reachable(links, links.select(F.col("source").alias("start")).distinct(), [], max_depth=4)


@query("graph_dependents", f"""
WITH RECURSIVE {PART_SQL}, walk(start, node, depth) AS (
  SELECT target, source, 1 FROM links
  UNION SELECT w.start, l.source, w.depth + 1 FROM walk w JOIN links l ON l.target = w.node WHERE w.depth < 6)
SELECT start, node, min(depth)::INT AS depth FROM walk WHERE start <> node GROUP BY 1, 2""")
def graph_dependents(spark, d):
    links = part_links(spark, d)
    return G.dependents(links, links.select(F.col("target").alias("start")).distinct(), [], max_depth=6)


def _start_sql(end: str, step: str) -> str:
    """From two given nodes to the end of the graph; UNION stops the walk where nothing is new."""
    a, b = ("source", "target") if end == "source" else ("target", "source")
    return f"""
WITH RECURSIVE {PART_SQL}, given AS (SELECT min({a}) AS start FROM links UNION SELECT max({a}) FROM links),
walk(start, node, depth) AS (SELECT start, start, 0 FROM given
  UNION SELECT w.start, l.{b}, w.depth + 1 FROM walk w JOIN links l ON l.{a} = w.node WHERE w.depth < (SELECT count(DISTINCT {step}) FROM links))
SELECT start, node, min(depth)::INT AS depth FROM walk WHERE start <> node GROUP BY 1, 2"""


def _given(links, end):
    ends = links.agg(F.min(end).alias("a"), F.max(end).alias("b"))
    return ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("start"))


@query("reachable_from_given", _start_sql("source", "source"))
def reachable_from_given(spark, d):
    links = part_links(spark, d)
    return G.reachable(links, _given(links, "source"), [])


@query("dependents_of_given", _start_sql("target", "target"))
def dependents_of_given(spark, d):
    links = part_links(spark, d)
    return G.dependents(links, _given(links, "target"), [])


@query("graph_cycles", f"""
WITH RECURSIVE {RING_SQL}, walk(a, b) AS (
  SELECT source, target FROM links UNION SELECT w.a, l.target FROM walk w JOIN links l ON l.source = w.b),
both_ways AS (SELECT x.a AS node, x.b AS other FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b)
SELECT least(node, min(other)) AS component, node FROM both_ways GROUP BY node""")
def graph_cycles(spark, d):
    return G.components(ring_links(spark, d), [])


def _impact_sql(links: str) -> str:
    return f"""
WITH RECURSIVE {links}, walk(node, above) AS (
  SELECT target, source FROM links UNION SELECT l.target, w.above FROM walk w JOIN links l ON l.source = w.node),
nodes AS (SELECT source AS node FROM links UNION SELECT target FROM links)
SELECT n.node, count(DISTINCT above) FILTER (above <> n.node)::BIGINT AS dependents FROM nodes n LEFT JOIN walk w ON w.node = n.node GROUP BY n.node"""


@query("impact_counts", _impact_sql(PART_SQL))
def impact_counts(spark, d):
    """How many parts lead to each part, over any number of links."""
    links = part_links(spark, d)
    return G.impact_counts(G.endpoints_of(links, []), links, [])


@query("impact_counts_cycles", _impact_sql(RING_SQL))
def impact_counts_cycles(spark, d):
    """The same on rings of customers with links between rings."""
    links = ring_links(spark, d)
    return G.impact_counts(G.endpoints_of(links, []), links, [])


@query("flow_reach", f"""
WITH RECURSIVE {RING_SQL}, walk(start, node, depth) AS (
  SELECT DISTINCT source, source, 0 FROM links
  UNION SELECT w.start, l.target, w.depth + 1 FROM walk w JOIN links l ON l.source = w.node WHERE w.depth < 40),
least AS (SELECT start, node, min(depth)::INT AS depth FROM walk GROUP BY 1, 2)
SELECT start, node, depth, row_number() OVER (PARTITION BY start ORDER BY depth, node)::INT AS seq, count(*) OVER (PARTITION BY start) AS total
FROM least WHERE depth > 0 QUALIFY seq <= 12""")
def flow_reach(spark, d):
    """The twelve nearest customers of each, over rings and the links between them, and how many it reaches in all."""
    links = ring_links(spark, d)
    return G.flow_reach(links, links.select(F.col("source").alias("start")).distinct(), [], 12)


def _pagerank_sql(rounds: int = 30) -> str:
    ctes = [TRADE_SQL, "e AS MATERIALIZED (SELECT repo, source, target FROM lifted)",
            "n AS MATERIALIZED (SELECT repo, node, count(*) OVER (PARTITION BY repo) AS cnt FROM (SELECT repo, source AS node FROM e UNION SELECT repo, target FROM e))",
            "g AS MATERIALIZED (SELECT repo, source, count(*) AS deg FROM e GROUP BY 1, 2)",
            "r0 AS (SELECT repo, node, 1.0::DOUBLE / cnt AS r FROM n)"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"r{i} AS MATERIALIZED (SELECT n.repo, n.node, (0.15 / n.cnt + 0.85 * (coalesce(c.s, 0) + coalesce(z.m, 0) / n.cnt))::DOUBLE AS r FROM n "
            f"LEFT JOIN (SELECT e.repo, e.target AS node, sum(r / deg) AS s FROM e JOIN r{i-1} p ON p.repo = e.repo AND p.node = e.source "
            f"JOIN g ON g.repo = e.repo AND g.source = e.source GROUP BY 1, 2) c ON c.repo = n.repo AND c.node = n.node "
            f"LEFT JOIN (SELECT p.repo, sum(r) AS m FROM r{i-1} p LEFT JOIN g ON g.repo = p.repo AND g.source = p.node WHERE g.deg IS NULL GROUP BY 1) z ON z.repo = n.repo)")
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT repo, node, round(r / sum(r) OVER (PARTITION BY repo), 4) AS rank FROM r{rounds}")


@query("pagerank", _pagerank_sql())
def pagerank(spark, d):
    e = cut(lifted_trade(spark, d))
    return G.pagerank(G.endpoints_of(e, ["repo"]), e, ["repo"], digits=4)


@query("top_nodes", f"""
WITH {TRADE_SQL}, f AS (
  SELECT repo, node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, sum(w)::BIGINT AS weight FROM (
    SELECT repo, source AS node, 0 AS i, 1 AS o, weight AS w FROM lifted UNION ALL SELECT repo, target, 1, 0, weight FROM lifted) GROUP BY 1, 2)
SELECT repo, node, fan_in, fan_out, weight, row_number() OVER (PARTITION BY repo ORDER BY weight DESC, node)::INT AS rank
FROM f QUALIFY rank <= 10""")
def top_nodes(spark, d):
    """Flagship: lift file links to groups, then the ten heaviest groups per repository with their fans."""
    e = lifted_trade(spark, d)
    ends = e.select("repo", F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), "weight"),
        F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), "weight"))).alias("e"))
    f = ends.groupBy("repo", F.col("e.node").alias("node")).agg(
        F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"), F.sum("e.weight").alias("weight"))
    return top_per_group(f, ["repo"], [F.desc("weight"), "node"], 10, rank="rank")
