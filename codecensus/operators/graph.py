"""Dependency-graph operators on edge tables ``(repo, source, target, kind, weight)``.

All of them take key columns that scope the graph (``keys``, usually ``["repo"]``), so one
job handles the graphs of every repository at once.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from codecensus.operators.windows import capped_list, numbered, top_per_group
from codecensus.session import cut as checkpoint, cut_round as cut, shuffled

Keys = list[str]


def dedupe_edges(edges: DataFrame, keys: Keys, evidence_order=None, evidence_limit: int = 8) -> DataFrame:
    """One row per (source, target, kind): summed weight, first evidence rows."""
    by = [*keys, "source", "target", "kind"]
    out = edges.groupBy(*by).agg(F.sum("weight").alias("weight"))
    if evidence_order is None:
        return out
    listed = capped_list(edges, by, evidence_order, F.col("evidence"), evidence_limit, "evidence")
    return out.join(listed, by)


def lift_edges(edges: DataFrame, mapping: DataFrame, keys: Keys, kind: str = "imports", drop_self: bool = True) -> DataFrame:
    """Map both ends through ``mapping(node, group)``, drop unmapped and inner edges, sum weights.

    Edges are summed per node pair first: a hot pair crosses the network once per task.
    """
    pre = edges.groupBy(*keys, "source", "target").agg(F.sum("weight").alias("weight"))
    known = mapping.where(F.col("group") != "")
    src = known.select(*keys, F.col("node").alias("source"), F.col("group").alias("__s"))
    dst = known.select(*keys, F.col("node").alias("target"), F.col("group").alias("__t"))
    both = pre.join(src, [*keys, "source"]).join(dst, [*keys, "target"])
    if drop_self:
        both = both.where(F.col("__s") != F.col("__t"))
    return both.groupBy(*keys, F.col("__s").alias("source"), F.col("__t").alias("target")).agg(
        F.sum("weight").alias("weight")
    ).withColumn("kind", F.lit(kind))


def edge_order() -> list:
    return [F.desc("weight"), "source", "target"]


def fan(edges: DataFrame, keys: Keys) -> DataFrame:
    """Fan-in and fan-out per node in one aggregation over both edge ends; self edges do not count."""
    ends = edges.where(F.col("source") != F.col("target")).select(
        *keys,
        F.explode(F.array(
            F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )).alias("e"),
    )
    return ends.groupBy(*keys, F.col("e.node").alias("node")).agg(
        F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")
    )


def instability(fans: DataFrame) -> DataFrame:
    """Outgoing share of all links, 0 for an isolated node."""
    total = F.col("fan_in") + F.col("fan_out")
    return fans.withColumn("instability", F.when(total > 0, F.round(F.col("fan_out") / total, 3)).otherwise(0.0))


def endpoints_of(edges: DataFrame, keys: Keys) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("source", "target")).alias("node")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Nodes that no edge touches."""
    touched = edges.select(*keys, F.explode(F.array("source", "target")).alias("node"))
    return nodes.join(touched, [*keys, "node"], "left_anti")


def neighbours(edges: DataFrame, keys: Keys) -> DataFrame:
    """Distinct (source, target) pairs. Rows, not an array: a hub may have any number of them."""
    return edges.select(*keys, "source", "target").distinct()


def dependents(edges: DataFrame, start: DataFrame, keys: Keys, max_depth: int | None = None) -> DataFrame:
    """Nodes that reach a start node, with the number of hops; within ``max_depth`` if that is given.

    ``start(keys, start)``; all start nodes advance together, frontier by frontier.
    """
    back = edges.select(*keys, F.col("target").alias("at"), F.col("source").alias("node")).distinct()
    return _spread(back, start, keys, max_depth)


def reachable(edges: DataFrame, start: DataFrame, keys: Keys, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from a start node, with the number of hops; within ``max_depth`` if that is given."""
    ahead = edges.select(*keys, F.col("source").alias("at"), F.col("target").alias("node")).distinct()
    return _spread(ahead, start, keys, max_depth)


def _spread(steps: DataFrame, start: DataFrame, keys: Keys, max_depth: int | None) -> DataFrame:
    by = [*keys, "start", "node"]
    steps = cut(steps.where(F.col("at") != F.col("node")))
    seen = start.select(*keys, "start", F.col("start").alias("node")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        ahead = (
            frontier.select(*keys, "start", F.col("node").alias("at"))
            .join(shuffled(steps), [*keys, "at"])
            .select(*by)
            .distinct()
            .join(shuffled(seen.select(*by)), by, "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        ahead = cut(ahead)
        if ahead.isEmpty():
            break
        seen = seen.unionByName(ahead)
        frontier = ahead
    return seen.where(F.col("depth") > 0)


def pagerank(
    nodes: DataFrame, edges: DataFrame, keys: Keys, damping: float = 0.85, iterations: int = 30,
    digits: int = 6, edges_per_slice: int = 1_000_000,
) -> DataFrame:
    """PageRank per graph; dangling mass spreads evenly, ranks sum to one.

    Let M spread a vector along the edges, times the damping. Every round adds the same
    constant c_t to all nodes of a graph, so after t rounds the rank is a sum of
    a_j * M^j(1). The powers need one join and one pre-combined sum per round and no value
    that depends on the whole graph; the few constants follow at the end, per graph.

    A node with very many out-edges is cut into slices of about ``edges_per_slice`` edges,
    and its value is handed to each slice, so no task owns a hub.
    """
    node = [*keys, "node"]
    inner = (
        edges.select(*keys, F.col("source").alias("node"), F.col("target"))
        .join(nodes.select(*node), node, "left_semi")
        .join(nodes.select(*keys, F.col("node").alias("target")), [*keys, "target"], "left_semi")
    )
    degree = checkpoint(inner.groupBy(*node).agg(F.count(F.lit(1)).alias("deg")))
    hubs = degree.where(F.col("deg") > edges_per_slice).select(*node, F.ceil(F.col("deg") / edges_per_slice).cast("int").alias("slices"))
    has_hubs = not hubs.isEmpty()
    steps = inner.join(degree, node)
    by = node
    if has_hubs:
        slices = F.ceil(F.col("deg") / edges_per_slice).cast("int")
        steps = steps.withColumn("slice", F.pmod(F.xxhash64("target"), slices).cast("int"))
        by = [*node, "slice"]
    width = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Placed once by their source, checkpointed: later rounds plan against a leaf and, as the
    # placement is kept, do not move the edges again.
    steps = checkpoint(steps.select(*by, "target", (F.lit(damping) / F.col("deg")).alias("w")).repartition(width, *by))
    power = checkpoint(nodes.select(*node, F.lit(0).alias("j"), F.lit(1.0).alias("value")))
    terms = [power]
    for j in range(1, iterations + 1):
        held = power
        if has_hubs:
            held = power.join(hubs, node, "left").select(
                *node, "value", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
        power = checkpoint(held.drop("j").join(steps, by).groupBy(*keys, F.col("target").alias("node")).agg(
            F.sum(F.col("value") * F.col("w")).alias("value")).select(*node, F.lit(j).alias("j"), "value"))
        terms.append(power)
    while len(terms) > 1:  # pairwise, so that the plan stays shallow
        terms = [x.union(y) for x, y in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2:]
    terms = terms[0]
    # Per graph: its size, and the full and the dangling sum of every power.
    flagged = terms.join(degree.select(*node, F.lit(True).alias("linked")), node, "left")
    per_power = flagged.groupBy(*keys, "j").agg(
        F.sum("value").alias("s"), F.sum(F.when(F.col("linked").isNull(), F.col("value")).otherwise(0.0)).alias("z"), F.count(F.lit(1)).alias("c"))
    graph = per_power.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("j", "s"))).alias("whole"), F.map_from_entries(F.collect_list(F.struct("j", "z"))).alias("loose"),
        F.max(F.when(F.col("j") == 0, F.col("c"))).alias("n"))
    at = lambda m, i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))
    dot = lambda a, m: F.aggregate(F.transform(a, lambda x, i: x * at(m, i.cast("int"))), F.lit(0.0), lambda s, x: s + x)
    coefficients = F.aggregate(
        F.sequence(F.lit(1), F.lit(iterations)), F.array(1.0 / F.col("n")),
        lambda a, _: F.concat(F.array(((1 - damping) + damping * dot(a, "loose")) / F.col("n")), a))
    graph = checkpoint(graph.withColumn("a", coefficients).withColumn("total", dot(F.col("a"), "whole")).select(*keys, "a", "total"))
    return _with_scalar(terms, graph, keys).groupBy(*node).agg(
        F.round(F.sum(F.col("value") * F.element_at("a", F.col("j") + 1) / F.col("total")), digits).alias("rank"))


def _with_scalar(df: DataFrame, per_graph: DataFrame, keys: Keys) -> DataFrame:
    """Attach per-graph values: a join on the graph key, or a scalar subquery for one graph."""
    if keys:
        return df.join(per_graph, keys, "left")
    for name in per_graph.columns:
        df = df.withColumn(name, per_graph.select(name).scalar())
    return df


def _trim(edges: DataFrame, keys: Keys, rounds: int = 2) -> DataFrame:
    """Drop edges whose ends cannot lie on a cycle (no way in, or no way out). Long tails are left to the contraction of chains."""
    n = edges.count()
    for _ in range(rounds):
        has_out = edges.select(*keys, F.col("source").alias("target")).distinct()
        has_in = edges.select(*keys, F.col("target").alias("source")).distinct()
        edges = cut(edges.join(shuffled(has_out), [*keys, "target"], "left_semi").join(shuffled(has_in), [*keys, "source"], "left_semi"))
        left = edges.count()
        if left in (0, n):
            break
        n = left
    return edges


def chains(edges: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """``(links, rings)`` of the nodes with one way in and one way out.

    ``links(keys, node, tail)``: the last node of the chain a node stands in. ``rings(keys, node, component)``: nodes of
    rings that nothing enters or leaves, named by their smallest. By pointer jumping: in every round a node takes over
    the pointer of the node it points to, so a chain of n nodes takes log2 n rounds. On a ring the smallest name of the
    nodes passed doubles its reach likewise; it stops changing when it has gone round.
    """
    node = [*keys, "node"]
    out = edges.groupBy(*keys, F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.first("target").alias("next")).where("o = 1")
    into = edges.groupBy(*keys, F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("i")).where("i = 1")
    single = cut(out.join(shuffled(into), node, "left_semi").select(*node, "next"))
    inner = single.select(*keys, F.col("node").alias("next"), F.lit(True).alias("goes"))
    state = cut(single.join(shuffled(inner), [*keys, "next"], "left").select(
        *node, F.when(F.col("goes"), F.col("next")).otherwise(F.col("node")).alias("at"), F.col("goes").isNull().alias("done"), F.col("node").alias("low"), F.lit(True).alias("moved")))
    settled, before = state.where("done"), None
    while True:
        now = state.where("NOT done").agg(F.count(F.lit(1)), F.count_if("moved")).first()
        if now[0] == 0 or (now[1] == 0 and before == now[0]):
            break
        before = now[0]
        there = state.select(*keys, F.col("node").alias("at"), F.col("at").alias("onward"), F.col("done").alias("ended"), F.col("low").alias("lower"))
        going = state.where("NOT done").join(shuffled(there), [*keys, "at"]).select(
            *node, F.col("onward").alias("at"), F.col("ended").alias("done"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("moved"))
        state = cut(going.unionByName(state.where("done")))
        settled = state.where("done")
    return settled.select(*node, F.col("at").alias("tail")), state.where("NOT done").select(*node, F.col("low").alias("component"))


def contract(edges: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """``(edges, members, rings)`` with every chain replaced by one edge; None if there is no chain.

    ``members(keys, node, before, after)``: nodes of a chain with the nodes it leads from and to. A node of a chain lies on
    a cycle just if those two do, and on the same.
    """
    links, rings = chains(edges, keys)  # both of a stored table
    if links.isEmpty() and rings.isEmpty():
        return None
    at = links.select(*keys, F.col("node").alias("source"), F.col("tail").alias("from_tail"))
    to = links.select(*keys, F.col("node").alias("target"), F.col("tail").alias("to_tail"))
    ring = rings.select(*keys, F.col("node").alias("source"))
    placed = cut(edges.join(shuffled(ring), [*keys, "source"], "left_anti").join(shuffled(at), [*keys, "source"], "left").join(shuffled(to), [*keys, "target"], "left"))
    head = placed.where("from_tail IS NULL AND to_tail IS NOT NULL").select(*keys, F.col("to_tail").alias("tail"), F.col("source").alias("before"))
    last = placed.where("from_tail = source AND to_tail IS NULL").select(*keys, F.col("from_tail").alias("tail"), F.col("target").alias("after"))
    ends = cut(head.join(shuffled(last), [*keys, "tail"]))
    kept = placed.where("from_tail IS NULL AND to_tail IS NULL").select(*keys, "source", "target")
    short = ends.where("before <> after").select(*keys, F.col("before").alias("source"), F.col("after").alias("target"))
    return cut(kept.unionByName(short).distinct()), links.join(shuffled(ends), [*keys, "tail"]).select(*keys, "node", "before", "after"), rings


def components(edges: DataFrame, keys: Keys) -> DataFrame:
    """Strongly connected components of more than one node: ``(keys, component, node)``, named by the smallest member.

    First what cannot lie on a cycle is trimmed and chains are contracted to single edges, again and again while that
    leaves fewer edges; long rings and tails go in as many rounds as their length has binary digits. What is left has
    short ways, and is coloured: the smallest label spreads forward until stable, then each colour's root walks backward
    inside its colour, and what it reaches is one component. Then the chains are put back.
    """
    left = cut(edges.where(F.col("source") != F.col("target")).select(*keys, "source", "target").distinct())
    # Names of members that trimming leaves; a column of the nodes' type without rows to begin with.
    found = left.select(*keys, F.col("source").alias("component"), F.col("source").alias("node")).limit(0)
    put_back: list[DataFrame] = []
    size = None
    while True:
        left = _trim(left, keys)
        now = left.count()
        if now == 0 or now == size:
            break
        size = now
        smaller = contract(left, keys)
        if smaller is None:
            break
        left, members, rings = smaller
        put_back.append(members)
        found = found.unionByName(rings.select(*keys, "component", "node"))
    found = cut(found.unionByName(_coloured(left, keys)))
    name = lambda n, c: found.select(*keys, F.col("node").alias(n), F.col("component").alias(c))
    for members in reversed(put_back):
        # The two ends are on one cycle, or are one node, which then is on a cycle by this chain.
        both = members.join(shuffled(name("before", "cb")), [*keys, "before"], "left").join(shuffled(name("after", "ca")), [*keys, "after"], "left").select(
            *keys, "node", "before", F.col("cb").isNull().alias("alone"), F.coalesce("cb", "before").alias("component"), F.coalesce("ca", "after").alias("other")).where("component = other")
        both = cut(both)
        found = cut(found.unionByName(both.select(*keys, "component", "node")).unionByName(both.where("alone").select(*keys, "component", F.col("before").alias("node")).distinct()))
    smallest = found.groupBy(*keys, "component").agg(F.min("node").alias("least"))
    return cut(found.join(shuffled(smallest), [*keys, "component"]).select(*keys, F.col("least").alias("component"), "node"))


def _coloured(left: DataFrame, keys: Keys) -> DataFrame:
    """Components by colouring: ``(keys, component, node)``; the component is some member."""
    node = [*keys, "node"]
    found = left.select(*keys, F.col("source").alias("component"), F.col("source").alias("node")).limit(0)
    while not left.isEmpty():
        colour = cut(endpoints_of(left, keys).withColumn("colour", F.col("node")))
        while True:
            sent = left.join(
                shuffled(colour.select(*keys, F.col("node").alias("source"), "colour")), [*keys, "source"]
            ).select(*keys, F.col("target").alias("node"), "colour")
            nxt = cut(
                colour.withColumn("old", F.col("colour"))
                .unionByName(sent.withColumn("old", F.lit(None).cast(colour.schema["node"].dataType)))
                .groupBy(*node).agg(F.min("colour").alias("colour"), F.max("old").alias("old"))
            )
            moved = not nxt.where(F.col("colour") != F.col("old")).isEmpty()
            colour = nxt.select(*node, "colour")
            if not moved:
                break
        tinted = (
            left.join(shuffled(colour.select(*keys, F.col("node").alias("source"), F.col("colour").alias("cs"))), [*keys, "source"])
            .join(shuffled(colour.select(*keys, F.col("node").alias("target"), F.col("colour").alias("ct"))), [*keys, "target"])
        )
        inner = cut(tinted.where("cs = ct").select(*keys, "source", "target", F.col("cs").alias("colour")))
        member = cut(colour.where(F.col("node") == F.col("colour")).select(*keys, "colour", "node"))
        frontier = member
        for hop in count(1):
            frontier = cut(
                frontier.select(*keys, "colour", F.col("node").alias("target"))
                .join(shuffled(inner), [*keys, "colour", "target"])
                .select(*keys, "colour", F.col("source").alias("node")).distinct()
                .join(shuffled(member), [*keys, "colour", "node"], "left_anti")
            )
            if frontier.isEmpty():
                break
            member = member.unionByName(frontier)
            if hop % 8 == 0:  # keeps the plan short
                member = cut(member)
        sized = member.groupBy(*keys, "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.unionByName(member.join(shuffled(sized.select(*keys, "colour")), [*keys, "colour"]).select(*keys, F.col("colour").alias("component"), "node"))
        # What was settled leaves the graph, so do edges between colours.
        settled = member.select(*keys, F.col("node").alias("source"))
        left = _trim(cut(
            inner.select(*keys, "source", "target").join(shuffled(settled), [*keys, "source"], "left_anti")
            .join(shuffled(settled.withColumnRenamed("source", "target")), [*keys, "target"], "left_anti")
        ), keys)
    return found


def condensed(nodes: DataFrame, edges: DataFrame, keys: Keys, scc: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(group, dag)``: the condensed node ``grp`` of every node, and the edges between condensed nodes."""
    node = [*keys, "node"]
    links = edges.where(F.col("source") != F.col("target")).select(*keys, "source", "target").distinct()
    if scc is None:
        scc = components(links, keys)
    all_nodes = nodes.select(*node).unionByName(endpoints_of(links, keys)).distinct()
    group = cut(
        all_nodes.join(shuffled(scc), node, "left").select(*node, F.coalesce("component", "node").alias("grp"))
    )
    dag = cut(
        links.join(shuffled(group.select(*keys, F.col("node").alias("source"), F.col("grp").alias("gs"))), [*keys, "source"])
        .join(shuffled(group.select(*keys, F.col("node").alias("target"), F.col("grp").alias("gt"))), [*keys, "target"])
        .where("gs <> gt").select(*keys, F.col("gs").alias("source"), F.col("gt").alias("target")).distinct()
    )
    return group, dag


def peeled(group: DataFrame, dag: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, grp, layer)`` of a graph without cycles: 0 without outgoing edges, else one above the highest target.

    The graph is peeled from the bottom: a node is ready once none of its remaining targets is open. A round is one
    checkpoint of the edges left, each with the word whether its source is ready now.
    """
    node = [*keys, "node"]
    left = dag.withColumn("ready", F.lit(False))
    done = cut(
        group.select(*keys, F.col("grp").alias("node")).distinct()
        .join(shuffled(dag.select(*keys, F.col("source").alias("node"))), node, "left_anti")
        .withColumn("layer", F.lit(0))
    )
    for depth in count(1):
        # Edges into settled nodes fall away; sources that keep no edge are this layer.
        open_nodes = left.select(*keys, F.col("source").alias("target"), F.lit(True).alias("open")).distinct()
        now = left.join(shuffled(open_nodes), [*keys, "target"], "left").select(*keys, "source", "target", F.col("open").isNotNull().alias("open"))
        held = now.groupBy(*keys, "source").agg(F.max("open").alias("waits"))
        now = cut(now.join(shuffled(held), [*keys, "source"]).where("open OR NOT waits"))
        ready = now.where("NOT waits").select(*keys, F.col("source").alias("node")).distinct().withColumn("layer", F.lit(depth))
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        if depth % 8 == 0:
            done = cut(done)
        left = now.where("waits").select(*keys, "source", "target")
    return done.select(*keys, F.col("node").alias("grp"), "layer")


def layers(nodes: DataFrame, edges: DataFrame, keys: Keys, scc: DataFrame | None = None) -> DataFrame:
    """Layer per node: 0 without outgoing edges, else one above the highest target.

    Members of a cycle are condensed to one node first, so they share a layer.
    """
    node = [*keys, "node"]
    group, dag = condensed(nodes, edges, keys, scc)
    return group.join(shuffled(peeled(group, dag, keys)), [*keys, "grp"]).select(*node, "layer").join(shuffled(nodes.select(*node)), node, "left_semi")


def impact_counts(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """``(keys, node, dependents)``: how many other nodes lead to a node, over any number of edges. Exact, and never lists the pairs.

    Cycles are condensed, and nodes get numbers; a condensed node holds the nodes that lead to it as bitmaps, one row for
    each 32,768 numbers. Going down the layers, the bitmaps of the nodes that lead to a node directly, and of these nodes
    themselves, are united; uniting is summed per task before it is shuffled, so a node that everything uses is no hot key.
    Swap ``source`` and ``target`` for the nodes that a node leads to.
    """
    group, dag = condensed(nodes, edges, keys)
    grp = [*keys, "grp"]
    # Layers from the top: 0 has no edge coming in.
    flipped = dag.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"))
    layer = peeled(group, flipped, keys)
    placed = numbered(group.join(shuffled(layer), grp), keys, ["layer", "grp", "node"], "number")
    placed = cut(placed)
    bits = lambda b: F.bitmap_or_agg(b).alias("bits")
    own = cut(placed.groupBy(*grp, "layer", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))
    size = placed.groupBy(*grp).agg(F.count(F.lit(1)).alias("size"))
    used = cut(dag.join(shuffled(layer.withColumnRenamed("grp", "target")), [*keys, "target"]).select(*keys, F.col("source").alias("grp"), "target", "layer"))
    # What a node hands on: itself and what leads to it.
    whole = own.where("layer = 0").select(*grp, "bucket", "bits")
    reach: DataFrame | None = None
    for depth in range(1, (layer.agg(F.max("layer")).first()[0] or 0) + 1):
        into = cut(used.where(F.col("layer") == depth).select(*grp, "target").join(shuffled(whole), grp).groupBy(*keys, F.col("target").alias("grp"), "bucket").agg(bits("bits")))
        counted = into.groupBy(*grp).agg(F.sum(F.bitmap_count("bits")).alias("above"))
        reach = counted if reach is None else reach.unionByName(counted)
        passed = into.unionByName(own.where(F.col("layer") == depth).select(*grp, "bucket", "bits")).groupBy(*grp, "bucket").agg(bits("bits"))
        whole = whole.unionByName(cut(passed))
        if depth % 16 == 0:
            whole, reach = cut(whole), cut(reach)
    known = group.join(shuffled(size), grp)
    known = known.join(shuffled(reach), grp, "left") if reach is not None else known.withColumn("above", F.lit(0).cast("long"))
    return known.select(*keys, "node", (F.coalesce("above", F.lit(0)) + F.col("size") - 1).cast("long").alias("dependents")).join(
        shuffled(nodes.select(*keys, "node")), [*keys, "node"], "left_semi")


def nearest(edges: DataFrame, start: DataFrame, keys: Keys, k: int, max_depth: int | None = None) -> DataFrame:
    """``(keys, start, node, depth, seq)``: the first ``k`` nodes that a start node reaches, in the order of hops and names.

    Every round keeps the best of what is new, up to what a start still lacks, so no start ever has more than ``k`` rows.
    That loses nothing: a node is dropped only when ``k`` nearer or smaller ones are held, and the way to any other leads
    through held ones. As at most ``k`` neighbours of a node are held already, its first 2 k + 1 are all that is asked for.
    """
    ahead = edges.where(F.col("source") != F.col("target")).select(*keys, F.col("source").alias("at"), F.col("target").alias("node")).distinct()
    steps = cut(top_per_group(ahead, [*keys, "at"], ["node"], 2 * k + 1))
    begin = [*keys, "start"]
    seen = cut(start.select(*begin, F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("seq")).distinct())
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = frontier.select(*begin, F.col("node").alias("at")).join(shuffled(steps), [*keys, "at"]).select(*begin, "node").distinct().join(
            shuffled(seen.select(*begin, "node")), [*begin, "node"], "left_anti")
        held = seen.groupBy(*begin).agg((F.count(F.lit(1)) - 1).cast("int").alias("held")).where(F.col("held") < k)
        first = top_per_group(new, begin, ["node"], k, rank="place").join(shuffled(held), begin).where(F.col("place") + F.col("held") <= k)
        frontier = cut(first.select(*begin, "node", F.lit(depth).alias("depth"), (F.col("place") + F.col("held")).alias("seq")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen.where("depth > 0")


def flow_reach(edges: DataFrame, start: DataFrame, keys: Keys, k: int, max_depth: int | None = None) -> DataFrame:
    """``nearest`` with ``total`` beside it: all nodes that the start leads to, over any number of edges."""
    near = nearest(edges, start, keys, k, max_depth)
    back = edges.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"))
    total = impact_counts(start.select(*keys, F.col("start").alias("node")).distinct(), back, keys)
    return near.join(shuffled(total.select(*keys, F.col("node").alias("start"), F.col("dependents").alias("total"))), [*keys, "start"])


def system_edges(systems: DataFrame, keys: Keys) -> DataFrame:
    """App -> external system edges; the kind of system decides the kind of edge."""
    k = F.col("kind")
    edge_kind = (
        F.when(k == "database", "db").when(k.isin("cache", "queue", "storage"), k).otherwise("http")
    )
    return systems.select(
        *keys, F.explode("apps").alias("source"), F.col("id").alias("target"), edge_kind.alias("kind"),
        F.lit(1).cast("long").alias("weight"),
        F.when(F.col("technology") != "", F.col("technology")).otherwise(k).alias("label"),
    )
