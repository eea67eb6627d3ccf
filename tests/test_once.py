"""Costly folds and scans stand once in a plan, not again in the filters below."""

import pytest


@pytest.fixture
def plan_of(spark, tmp_path):
    """The optimized plan of a query over parts."""
    spark.range(40).selectExpr("id AS p_partkey", "concat('Brand#', id % 3) AS p_brand", "concat('red part', id) AS p_name", "cast(id % 50 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")

    def plan(name):
        from codecensus.plans.all_queries import QUERIES

        return QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()

    return plan


@pytest.mark.parametrize("name, folds", [("kubernetes", 1), ("serverless_charts", 2), ("ci_jobs", 2)])
def test_yaml_is_read_once(plan_of, name, folds):
    assert plan_of(name).count(r"^[ \t]*(?:-(?:[ \t]+|$))*") == folds


@pytest.mark.parametrize("name", ["python_routes", "endpoints"])
def test_heads_are_joined_once(plan_of, name):
    plan = plan_of(name)
    assert plan.count(r"class[ \t])[^\n]*[(,\[{]") == 1 and "Join" not in plan


def test_markers_are_looked_for_once(plan_of):
    assert plan_of("frameworks_fired").count(r"(?i)\bfastapi\b") == 1


@pytest.mark.parametrize("name", ["compose_links", "infra_facts"])
def test_services_are_written_once(plan_of, name):
    assert r"^[ \t]*(?:-(?:[ \t]+|$))*" not in plan_of(name)
