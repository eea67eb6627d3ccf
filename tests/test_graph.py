import random

import pytest
from pyspark.sql import functions as F

from codecensus.operators import graph as G
from codecensus.operators import windows as W


def edges(spark, pairs, repo="r"):
    return spark.createDataFrame([(repo, a, b, "imports", 1) for a, b in pairs], "repo string, source string, target string, kind string, weight long")


def brute_rank(nodes, pairs, d=0.85, rounds=30):
    out = {n: [t for s, t in pairs if s == n and t in nodes] for n in nodes}
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        nxt = {n: (1 - d) / len(nodes) for n in nodes}
        for n in nodes:
            for t in out[n] or nodes:
                nxt[t] += d * r[n] / len(out[n] or nodes)
        r = nxt
    total = sum(r.values())
    return {n: v / total for n, v in r.items()}


@pytest.mark.parametrize("slice_size", [1_000_000, 3])
def test_pagerank_matches_power_iteration(spark, slice_size):
    rnd = random.Random(1)
    names = [f"n{i}" for i in range(12)]
    pairs = sorted({(rnd.choice(names[:8]), rnd.choice(names)) for _ in range(40)})
    nodes = spark.createDataFrame([("r", n) for n in names], "repo string, node string")
    got = {r.node: r["rank"] for r in G.pagerank(nodes, edges(spark, pairs), ["repo"], edges_per_slice=slice_size).collect()}
    want = brute_rank(names, pairs)
    assert all(abs(got[n] - want[n]) < 2e-6 for n in names) and abs(sum(got.values()) - 1) < 1e-4


def test_components_and_layers(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("d", "f"), ("self", "self")]
    e = edges(spark, pairs)
    scc = {r.node: r.component for r in G.components(e, ["repo"]).collect()}
    assert scc == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    lay = {r.node: r.layer for r in G.layers(G.endpoints_of(e, ["repo"]), e, ["repo"]).collect()}
    assert lay == {"f": 0, "d": 1, "e": 1, "a": 2, "b": 2, "c": 2, "x": 3, "self": 0}


def test_components_random(spark):
    rnd = random.Random(7)
    pairs = sorted({(f"n{rnd.randrange(25):02d}", f"n{rnd.randrange(25):02d}") for _ in range(34)})
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = set().union(*[reach.get(b, set()) for b in reach[a]]) - reach[a] if reach[a] else set()
            if more:
                reach[a] |= more
                changed = True
    want = {}
    for a in reach:
        same = {b for b in reach[a] if a in reach.get(b, set())} | {a}
        if len(same) > 1:
            want[a] = min(same)
    got = {r.node: r.component for r in G.components(edges(spark, pairs), ["repo"]).collect()}
    assert got == want


def test_lift_fan_orphans(spark):
    e = edges(spark, [("f1", "f2"), ("f1", "f3"), ("f2", "f3"), ("f3", "zz")])
    m = spark.createDataFrame([("r", "f1", "A"), ("r", "f2", "A"), ("r", "f3", "B")], "repo string, node string, group string")
    lifted = G.lift_edges(e, m, ["repo"]).collect()
    assert [(x.source, x.target, x.weight) for x in lifted] == [("A", "B", 2)]
    fans = {r.node: (r.fan_in, r.fan_out, r.instability) for r in G.instability(G.fan(e, ["repo"])).collect()}
    assert fans["f1"] == (0, 2, 1.0) and fans["f3"] == (2, 1, 0.333)
    nodes = spark.createDataFrame([("r", "f1"), ("r", "q")], "repo string, node string")
    assert [r.node for r in G.orphans(nodes, e, ["repo"]).collect()] == ["q"]
    dep = {r.node: r.depth for r in G.dependents(e, spark.createDataFrame([("r", "f3")], "repo string, start string"), ["repo"]).collect()}
    assert dep == {"f1": 1, "f2": 1}
    reach = {r.node: r.depth for r in G.reachable(e, spark.createDataFrame([("r", "f1")], "repo string, start string"), ["repo"], 4).collect()}
    assert reach == {"f2": 1, "f3": 1, "zz": 2}


@pytest.mark.parametrize("chunk", [3, 65536])
def test_forward_fill_with_hot_key(spark, chunk):
    rows = [("hot" if i % 3 else "cold", i, f"v{i}" if i % 7 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    got = {(r.k, r.i): r.f for r in W.forward_fill(df, ["k"], "i", "v", "f", chunk_rows=chunk).collect()}
    last = {}
    for k, i, v in rows:
        last[k] = v or last.get(k)
        assert got[(k, i)] == last[k]


def test_fold_and_overflow(spark):
    df = spark.createDataFrame([("r", f"l{i}", 10 - i) for i in range(10)] + [("s", "a", 1)], "repo string, label string, n long")
    got = {(r.repo, r.label): r.n for r in W.fold_other(df, ["repo"], "label", "n", 4).collect()}
    assert got == {("r", "l0"): 10, ("r", "l1"): 9, ("r", "l2"): 8, ("r", "Other (7)"): 28, ("s", "a"): 1}
    more = {(r.repo, r.label) for r in W.with_overflow(df, ["repo"], "label", ["label"], 8).collect()}
    assert ("r", "+2 more") in more and ("s", "a") in more and len(more) == 10
    small = {(r.repo, r.label): (r.n, r.merged) for r in W.merge_smallest(df, ["repo"], "label", "n", 5).collect()}
    assert small[("r", "(other)")] == (21, 6) and small[("s", "a")] == (1, 0) and len(small) == 6


def closure(pairs):
    reach = {a: {b for x, b in pairs if x == a} for p in pairs for a in p}
    changed = True
    while changed:
        changed = False
        for a, r in reach.items():
            more = set().union(*[reach[b] for b in r]) - r if r else set()
            r |= more
            changed |= bool(more)
    return reach


def shapes():
    rnd = random.Random(11)
    ring = lambda names: list(zip(names, names[1:] + names[:1]))
    r = [f"r{k:02d}" for k in range(13)]
    yield "a ring alone", ring(r)
    yield "a ring with a tail in and out", ring(r) + [("x", "r05"), ("y", "x"), ("r09", "z"), ("z", "zz")]
    yield "two rings at one node", ring(r[:9]) + ring(["r00", *r[10:]])
    yield "a ring of two ways", ring(r[:10]) + [("r03", "m1"), ("m1", "m2"), ("m2", "r07")]
    yield "a long path", list(zip(r, r[1:]))
    yield "two paths that meet", list(zip(r[:9], r[1:10])) + [("r00", "q1"), ("q1", "q2"), ("q2", "r09")]
    yield "a pair, a self edge and nothing", [("a", "b"), ("b", "a"), ("c", "c")]
    for n, m in ((20, 24), (20, 30), (30, 33), (12, 40)):
        yield f"random {n} {m}", sorted({(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(m)})


def test_components_and_impact_of_shapes(spark):
    """All shapes in one run, each a repository of its own, forward and backward."""
    rows, want, counts = [], {}, {}
    for name, pairs in shapes():
        for repo, way in ((name, pairs), (f"{name} back", [(b, a) for a, b in pairs])):
            reach = closure(way)
            rows += [(repo, a, b, "imports", 1) for a, b in way]
            want |= {(repo, a): min(b for b in [a, *r] if a == b or a in reach[b]) for a, r in reach.items() if any(b != a and a in reach[b] for b in r)}
            counts |= {(repo, n): sum(n in r for a, r in reach.items() if a != n) for n in reach}
    e = spark.createDataFrame(rows, "repo string, source string, target string, kind string, weight long")
    assert {(r.repo, r.node): r.component for r in G.components(e, ["repo"]).collect()} == want
    assert {(r.repo, r.node): r.dependents for r in G.impact_counts(G.endpoints_of(e, ["repo"]), e, ["repo"]).collect()} == counts


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []  # the whole is 17 doublings
    monkeypatch.setattr(G, "cut", lambda df, real=G.cut: rounds.append(1) or real(df))
    ring = spark.range(n).select(F.col("id").alias("source"), ((F.col("id") + 1) % n).alias("target"))
    inside = G.chains(ring, [])[1]
    assert len(rounds) < 25 and inside.agg(F.count("*"), F.min("component"), F.max("component")).first()[:] == (n, 0, 0)


def test_impact_beyond_one_bitmap(spark):
    n = 70_000
    e = spark.range(n).select(F.col("id").alias("source"), F.lit(-1).cast("long").alias("target")).union(spark.createDataFrame([(-1, -2)], "source long, target long"))
    got = {r.node: r.dependents for r in G.impact_counts(G.endpoints_of(e, []), e, []).where("node < 1").collect()}
    assert got == {0: 0, -1: n, -2: n + 1}


@pytest.mark.parametrize(("k", "depth"), [(3, None), (4, 2)])
def test_nearest_equals_brute_force(spark, k, depth):
    rnd = random.Random(5)
    pairs = sorted({(f"n{rnd.randrange(30):02d}", f"n{rnd.randrange(30):02d}") for _ in range(60)} | {("n00", f"m{j:03d}") for j in range(40)})
    want = set()
    starts = ["n00", "n03", "n07"]
    reach = closure(pairs)
    for s in starts:
        seen, level, hop, order = {s}, [s], 0, []
        while level and (depth is None or hop < depth):
            hop += 1
            level = sorted({b for a, b in pairs if a in level} - seen)
            seen |= set(level)
            order += [(n, hop) for n in level]
        want |= {(s, n, h, i + 1, len(reach.get(s, set()) - {s})) for i, (n, h) in enumerate(order[:k])}
    got = G.flow_reach(edges(spark, pairs), spark.createDataFrame([("r", s) for s in starts], "repo string, start string"), ["repo"], k, depth)
    assert {(r.start, r.node, r.depth, r.seq, r.total) for r in got.collect()} == want
