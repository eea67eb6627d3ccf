"""Joins of tables that grow with the input move rows by key; none of them passes the driver."""

import pytest


@pytest.fixture
def plan_of(spark, tmp_path):
    """The physical plan of a query over parts and others, read from files that are small however many rows they make."""
    spark.range(40).selectExpr("id AS p_partkey", "concat('Brand#', id % 3) AS p_brand", "concat('red part', id) AS p_name", "cast(id % 50 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")

    def plan(name):
        from codecensus.plans.all_queries import QUERIES

        return QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()

    return plan


@pytest.mark.parametrize("name", ["import_resolution", "resolve_aliases", "resolve_pathlike", "resolve_languages"])
def test_resolution_broadcasts_nothing(plan_of, name):
    plan = plan_of(name)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_graph_rounds_broadcast_nothing(spark, monkeypatch):
    from codecensus.operators import graph as G

    plans, real = [], G.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(G, "cut", seen)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "source string, target string").coalesce(1)
    assert {tuple(r) for r in G.components(edges, []).collect()} == {("a", "a"), ("a", "b")}
    near = G.nearest(edges, edges.select(edges.source.alias("start")).distinct(), [], 2)
    assert {(r.start, r.node, r.depth) for r in near.collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
