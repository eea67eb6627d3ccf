"""Queries over whole tables: no side of a join is empty, and every kind of match and of row without one occurs."""

import os

import pytest

from codecensus.plans import all_queries, relation_queries as R
from codecensus.plans.registry import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name):
    return all_queries.QUERIES[name](spark, SF).collect()


def test_sides_hold_all_rows(spark):
    declared, locked, usage = R._deps(spark, SF)
    assert declared.count() == table(spark, SF, "part").count()
    n = sum(int(r.version[2:]) for r in locked.collect()), sum(r.n_files for r in usage.collect())
    assert min(n) > 0 and sum(n) == table(spark, SF, "lineitem").count()


def test_every_case_of_a_dependency_occurs(spark):
    got = rows(spark, "reconcile")
    assert {(r.direct, r.used) for r in got} == {(a, b) for a in (True, False) for b in (True, False)}
    assert any(r.direct and r.version.startswith("9.") for r in got)  # declared, with the locked version
    assert any(r.marks == "unused,unpinned" for r in got)
    assert rows(spark, "undeclared")
    assert {r.identifier for r in rows(spark, "dependency_findings")} == {f"CC-DEP-{x}" for x in ("NOLOCK", "UNPINNED", "UNUSED", "MISSING")}


def test_orphans_are_some_of_the_parts(spark):
    assert 0 < len(rows(spark, "orphan_parts")) < table(spark, SF, "part").count()


def test_whole_texts_and_words(spark):
    texts = {r.text for r in table(spark, SF, "conversations").collect()}
    sections = {r.section for r in rows(spark, "forward_fill")} - {None}
    assert sections <= texts and max(map(len, sections)) > 12
    assert min(len(r.word) for r in rows(spark, "word_entropy")) == 1
    assert rows(spark, "common_dirs")
