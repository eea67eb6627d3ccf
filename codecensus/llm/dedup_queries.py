"""Queries of the near-duplicate operator and the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecensus.llm.common import query, table
from codecensus.llm.minhash_dedup import near_duplicates

SHINGLES_SQL = r"""
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh FROM w)"""


@query("op2_minhash_near_dedup", rf"""
WITH RECURSIVE {SHINGLES_SQL},
    s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM sets),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM s x JOIN s y ON x.x = y.x AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, CAST(len(d.sh) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM sets d JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, len(d.sh)""")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")
