"""Every rule of the fixed tables fires on the files that the queries derive, and stays silent on others."""

import os
import re

import pytest

from codecensus.plans import all_queries, rule_queries as Q
from codecensus.plans.registry import table
from codecensus.rules import languages, security, systems

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name):
    return all_queries.QUERIES[name](spark, SF).collect()


def test_samples_match():
    assert {s[3][0] for s in Q.CODE if len(s) > 3} == {r["id"] for r in security.RULES}
    for pattern in [s[4] for s in systems.SIGNATURES] + [r[2] for r in languages.FRAMEWORKS] + [r[0] for r in systems.IMAGES]:
        assert re.search(pattern, Q.sample_of(pattern), 0 if pattern.startswith("(?i)") else re.I), pattern


def test_all_fire(spark):
    n = table(spark, SF, "part").count()
    fired = rows(spark, "rules_fired")
    assert {r.identifier for r in fired} == {"CC-" + r["id"].upper() for r in security.RULES}
    files = {r.file.split("/")[0] for r in fired}
    silent = {f"m{k}" for k in range(1, n + 1) if len(Q.CODE[k % len(Q.CODE)]) == 3}
    assert silent and not files & silent and len(files) + len(silent) == n
    signs = rows(spark, "signatures_fired")
    assert {r.id for r in signs} == {s[0] for s in systems.SIGNATURES} and {r.note for r in signs} == {"", "mentioned in prose"}
    assert {r.framework for r in rows(spark, "frameworks_fired")} == {r[1] for r in languages.FRAMEWORKS}
    assert {r.name for r in rows(spark, "image_rules")} == {r[1] for r in systems.IMAGES} - {"Temporal"}  # an earlier rule takes every such image
