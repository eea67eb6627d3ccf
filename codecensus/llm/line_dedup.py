"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line the share of the host's pages that hold it is computed, and lines above the
boilerplate ratio are dropped from the pages of that host. Only hashes of lines are shuffled for the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.llm.minhash_dedup import text_key
from codecensus.llm.native import bounded, exploded
from codecensus.session import cut

BREAK = "\n"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def _key(line: Column) -> Column:
    """Hash of a line without the blanks at its ends; null for a blank line."""
    bare = F.trim(F.regexp_replace(line, r"^[\x09-\x0D ]+|[\x09-\x0D ]+$", ""))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, host: str, lines: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, line) above the ratio, from (host, array of distinct line hashes)."""
    totals = pages.groupBy(host).agg(F.count("*").alias("pages"))
    held = exploded(pages, F.col(lines), "line", host).groupBy(host, "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return held.alias("h").join(totals.alias("t"), F.expr(f"h.{host} <=> t.{host}")).where(F.col("n") > max_ratio * F.col("pages")).select(f"h.{host}", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, max_ratio: float = 0.05, min_pages: int = 5,
                uncounted: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with their own columns and, beside them, (_n_lines, _n_dropped): the text has lost its boilerplate lines.

    A line is boilerplate on a host if at least ``min_pages`` pages of the host and more than ``max_ratio`` of them hold
    it; blanks at its ends do not count, and blank lines are never boilerplate. Rows named in ``uncounted`` (doc_id,
    text_key), copies of others say, are not counted as pages but lose their lines like all. Null texts stay null, null
    hosts are one host, every row counts as a page, so repeated rows count again. Texts are read whole. An empty table
    gives an empty result. Other columns keep their names and values, but for those named _n_lines and _n_dropped, which
    give way.
    """
    none = F.array().cast("array<bigint>")
    read = docs.select(F.col(host_col).alias("host"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       F.array_distinct(F.array_compact(F.transform(_lines(F.col(text_col)), _key))).alias("lines"))
    if uncounted is not None:
        gone = uncounted.select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key"))
        read = read.join(bounded(gone), F.expr("id <=> gone and key = gone_key"), "left_anti")
    bad = boilerplate(read.select("host", "lines"), "host", "lines", max_ratio, min_pages)
    # A host has few: each stands on a share of its pages, so there are at most the lines of an average page over the ratio.
    by_host = bounded(cut(bad.groupBy("host").agg(F.collect_set("line").alias("bad"))))
    rows = docs.select(F.struct("*").alias("d")).join(by_host, F.col(f"d.{host_col}").eqNullSafe(F.col("host")), "left")
    keys = F.transform(_lines(F.col("d")[text_col]), lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    rows = rows.select("d", F.coalesce("bad", none).alias("bad"), keys.alias("keys"))
    rows = rows.withColumn("kept", F.filter("keys", lambda x: x["key"].isNull() | ~F.array_contains("bad", x["key"])))
    rows = rows.withColumn("n", F.size(F.filter("keys", lambda x: x["key"].isNotNull())).cast("long")).withColumn("dropped", (F.size("keys") - F.size("kept")).cast("long"))
    text = F.when(F.col("dropped") > 0, F.concat_ws(BREAK, F.transform("kept", lambda x: x["line"]))).otherwise(F.col("d")[text_col])
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return rows.select(*[(text if c == text_col else F.col("d")[c]).alias(c) for c in own], F.col("n").alias("_n_lines"), F.col("dropped").alias("_n_dropped"))
