"""Queries of the operators that read each text on its own, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecensus.llm.common import query, table
from codecensus.llm.html_text import extract_pages
from codecensus.llm.language_id import identify
from codecensus.llm.pii_redaction import find_personal_data
from codecensus.llm.quality_rules import quality_rules
from codecensus.llm.secret_scan import secret_scan


@query("op10_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source AS host FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
    five AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
    twice AS (SELECT doc_id, s FROM five GROUP BY doc_id, s HAVING count(*) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM five SEMI JOIN twice USING (doc_id, s)) GROUP BY doc_id),
    lines AS (SELECT doc_id, host, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
        FROM (SELECT doc_id, host, unnest(ls) AS l FROM w)),
    full_lines AS (SELECT *, len(lw) AS n, regexp_replace(array_to_string(lw, ' '), '[0-9]+', '0', 'g') AS norm FROM lines WHERE len(lw) > 0),
    dup AS (SELECT doc_id, sum(k - 1) AS n FROM (SELECT doc_id, l, count(*) AS k FROM full_lines GROUP BY doc_id, l) GROUP BY doc_id),
    totals AS (SELECT host, count(*) AS documents FROM d GROUP BY host),
    common AS (SELECT f.host, f.norm FROM full_lines f JOIN totals t USING (host) GROUP BY f.host, f.norm, t.documents
        HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.1 * t.documents),
    lost AS (SELECT doc_id, sum(n) AS n FROM full_lines SEMI JOIN common USING (host, norm) GROUP BY doc_id),
    facts AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum([len(x) FOR x IN ws]), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_common_words
        FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)),
    judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(n_common_words AS BIGINT) AS n_common_words,
    NOT base_failed AND 100 * (n_words - n_common_words) >= 30 * n_words AS kept FROM judged""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op9_pii_boosting")
def op9_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
