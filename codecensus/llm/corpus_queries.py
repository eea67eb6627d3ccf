"""Queries of the operators that compare or mix whole corpora, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecensus.llm.common import query, table
from codecensus.llm.line_dedup import dedup_lines
from codecensus.llm.mixing import mix


@query("op1_line_dedup", r"""
WITH l AS (SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    n AS (SELECT *, regexp_replace(line, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g') AS bare FROM l),
    bad AS (SELECT source, bare FROM n JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) USING (source) WHERE bare <> ''
        GROUP BY source, bare, pages HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > 0.05 * pages),
    f AS (SELECT n.*, b.bare IS NOT NULL AS dropped FROM n LEFT JOIN bad b USING (source, bare))
SELECT doc_id, source, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text FROM f GROUP BY doc_id, source""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).selectExpr("doc_id", "source", "_n_lines AS n_lines", "_n_dropped AS n_dropped", "text")


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
