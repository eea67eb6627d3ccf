"""Queries of the operators that draw, encode and rearrange training text, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codecensus.llm.byte_bpe import decoded, encode, token_count
from codecensus.llm.common import query, table
from codecensus.llm.fill_middle import fill_in_middle, restored
from codecensus.llm.resampling import resample


@query("op11_importance_resampling", r"""
WITH steps AS (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step
        FROM (SELECT unnest(range(256)) AS i)),
    texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
    w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
    f AS (SELECT side, id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])) AS x FROM w),
    hexed AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM f)),
    bucketed AS (SELECT x, xor(list_reduce([('0x' || h[2 * k + 1:2 * k + 2])::BIGINT FOR k IN range(len(h) // 2)], lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
        FROM hexed, steps),
    fb AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN bucketed USING (x) GROUP BY ALL),
    sums AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM fb),
    per AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM fb GROUP BY bucket),
    gain AS (SELECT bucket, floor(1000 * ln((per.t + 1)::DOUBLE * (sums.s + 10000)::DOUBLE / ((per.s + 1)::DOUBLE * (sums.t + 10000)::DOUBLE)))::BIGINT AS gain FROM per, sums),
    weights AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
    scored AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS may,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM w LEFT JOIN weights ON doc_id = w.id WHERE side = 'd'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER (PARTITION BY may) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= drawn THEN place END AS rank FROM placed""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))


@query("op13_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
    l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, [('0x' || h[8 * k + 1:8 * k + 8])::UBIGINT::BIGINT FOR k IN range(4)] AS r FROM d),
    n AS (SELECT *, len(ls) AS n, least(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS a, greatest(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
    p AS (SELECT *, coalesce(array_to_string(ls[1:a], ''), '') AS head, coalesce(array_to_string(ls[a + 1:b], ''), '') AS middle, coalesce(array_to_string(ls[b + 1:], ''), '') AS tail FROM n)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(head) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
