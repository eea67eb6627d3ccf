"""Queries of the native scans for benchmark items and license notices, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecensus.llm.common import query, table
from codecensus.llm.decontaminate import leaks
from codecensus.llm.license_scan import TEMPLATES, scan_licenses


def _containment_sql(parts: str, name: str, pattern: str, result: str, whole: bool = False) -> str:
    shingles = "[array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]"
    if whole:
        shingles = f"CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')] ELSE {shingles} END"
    return rf"""
WITH parts AS ({parts}),
    p AS (SELECT DISTINCT {name}, unnest({shingles}) AS x FROM (SELECT {name}, regexp_extract_all(lower(text), '{pattern}') AS ws FROM parts)),
    weights AS (SELECT x, greatest(1, 1000 // count(*)) AS weight FROM p GROUP BY x),
    totals AS (SELECT {name}, sum(weight) AS total FROM p JOIN weights USING (x) GROUP BY {name}),
    d AS (SELECT DISTINCT doc_id, unnest({shingles}) AS x FROM (SELECT doc_id, regexp_extract_all(lower(text), '{pattern}') AS ws FROM documents)),
    found AS (SELECT doc_id, {name}, sum(weight) AS shared FROM d JOIN p USING (x) JOIN weights USING (x) GROUP BY doc_id, {name})
SELECT doc_id, {name}, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total, CAST(shared AS DOUBLE) / total AS {result}
FROM found JOIN totals USING ({name}) WHERE 100 * shared >= 80 * total"""


@query("op4_benchmark_decontamination", _containment_sql("SELECT item_id, text FROM benchmark", "item_id", r"[^\x20\x09-\x0D]+", "similarity", whole=True))
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LISTED = " UNION ALL ".join("SELECT '{}' AS license, '{}' AS text".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))


@query("op6_license_scan", _containment_sql(_LISTED, "license", "[a-z0-9]+", "containment"))
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
