"""Quality rules by cross-document line frequency.

Lines are normalised and hashed, the documents of a host that hold each line are counted, lines above the limit are
taken out, and a document that loses most of its words is rejected. Simple in-text rules come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from codecensus.llm.common import slices
from codecensus.session import cut

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_DIGITS = re.compile(rb"[0-9]+")


def normalised_line(line: bytes) -> bytes:
    """Words of a line, A-Z lower-cased, one space apart, digit runs as 0."""
    return _DIGITS.sub(b"0", b" ".join(line.lower().split()))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text. Exact: windows are numbered, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # Numbers of pairs, of fours, of fives: each below n times the vocabulary, so products stay in 64 bits.
    ids = number[:n]
    for k in range(1, window):
        _, ids, counts = np.unique(ids * len(known) + number[k : k + n], return_inverse=True, return_counts=True)
        if k < window - 1 and counts.max() == 1:
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def text_facts(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words under each hash)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    duplicates = 0
    by_line: dict[int, int] = {}
    for line in lines:
        n = len(line.split())
        if not n:
            continue
        duplicates += line in seen
        seen.add(line)
        key = xxhash.xxh3_64_intdigest(normalised_line(line)) - 2**63
        by_line[key] = by_line.get(key, 0) + n
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words), list(by_line), list(by_line.values())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, max_share: float = 0.1,
                  min_documents: int = 20, min_left_percent: int = 30, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words, kept).

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in windows found
    twice. A line is common if more than ``min_documents`` documents of its host and more than ``max_share`` of them hold
    it; ``n_common_words`` are the words in such lines, and a document keeps at least ``min_left_percent`` percent of its
    words or goes. Null and empty texts have no words and fail. Null hosts are one host. Every row counts as a document,
    so repeated rows count again. An empty table gives an empty result; other columns are ignored.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            facts = pd.DataFrame([text_facts(t) for t in batch["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sizes"])
            yield pd.concat([batch[["row", "doc_id", "host"]].reset_index(drop=True), facts], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = cut(rows.mapInPandas(scan, f"row long, doc_id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, sizes array<long>"))
    held = rows.select("row", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select("row", "host", "l.lines", "l.sizes")
    totals = rows.groupBy("host").agg(F.count("*").alias("documents"))
    common = held.groupBy("host", "lines").agg(F.count("*").alias("n")).where(F.col("n") > min_documents).alias("c").join(
        totals.alias("t"), F.expr("c.host <=> t.host")).where(F.col("n") > max_share * F.col("documents")).select("c.host", "c.lines")
    lost = held.alias("h").join(common.alias("c"), F.expr("h.host <=> c.host and h.lines = c.lines")).groupBy("row").agg(F.sum("sizes").alias("n_common_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    return rows.join(lost, "row", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_common_words",
        (~failed & (100 * left >= min_left_percent * F.col("n_words"))).alias("kept"))
