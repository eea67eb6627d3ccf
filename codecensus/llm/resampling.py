"""Target-distribution importance resampling over hashed word runs.

Features of corpus and target fall into buckets by CRC-32. The log ratio of a bucket's shares is its gain, a document's
weight is the mean gain of its features, and a document's score adds seeded Gumbel noise to the weight, so that taking
the highest scores draws without replacement.

Checksums are taken for all distinct features of a slice of texts at once: features of equal length form a matrix of
bytes, one feature a row, and the checksums of all rows advance together, column by column. Results go back to the
places the features came from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codecensus.llm.common import ranked, slices
from codecensus.session import cut

BUCKETS, RUNS, PERCENT, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Longer features are alone in their length, so that a matrix of them would be one row; the library's checksum takes them.
LONG_FEATURE = 4096

#: A-Z become a-z; 0-9, a-z and bytes of other characters stay; all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


CRC_STEPS = _crc_steps()


def crc32_all(items: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of every item, worked out in one matrix for each length."""
    out = np.zeros(len(items), np.uint32)
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(lengths, kind="stable")
    starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for rows in np.split(order, starts[1:]):
        if not len(rows):
            continue
        length = int(lengths[rows[0]])
        if length > LONG_FEATURE:
            out[rows] = [zlib.crc32(items[i]) for i in rows]
            continue
        matrix = np.frombuffer(b"".join([items[i] for i in rows]), np.uint8).reshape(len(rows), length)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = CRC_STEPS[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def feature_buckets(texts: list[str | None], runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature) for all runs of 1 to ``runs`` words."""
    known: dict[bytes, int] = {}
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        before = len(flat)
        flat.extend([known.setdefault(w, len(known)) for w in words(text)])
        sizes[k] = len(flat) - before
    number = np.array(flat, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    vocabulary = list(known)
    ids, items = number, vocabulary
    owners, found = [owner], [crc32_all(items)[ids] % buckets]
    for run in range(2, runs + 1):
        # A run is the run one word shorter that starts with it, and its last word; both must lie in one text.
        n = max(len(number) - run + 1, 0)
        inside = owner[:n] == owner[run - 1 :][:n]
        if run > 2:
            placed = np.full(len(number), -1, np.int64)
            placed[places] = ids
            ids = placed
        places = np.flatnonzero(inside)
        distinct, ids = np.unique(ids[places] * max(len(vocabulary), 1) + number[places + run - 1], return_inverse=True)
        heads, tails = np.divmod(distinct, max(len(vocabulary), 1))
        items = [items[h] + b" " + vocabulary[t] for h, t in zip(heads.tolist(), tails.tolist(), strict=True)]
        owners.append(owner[places])
        found.append(crc32_all(items)[ids] % buckets)
    return sizes, np.concatenate(owners), np.concatenate(found).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts. A task sums its own counts, so ``buckets`` rows of it at most are shuffled."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(feature_buckets(list(batch["text"]), runs, buckets)[2], minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    return texts.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the log of the target's smoothed share over the corpus' share, floored."""
    corpus, aim = cut(bucket_counts(docs, text_col, runs, buckets)), cut(bucket_counts(target, target_text, runs, buckets))
    size, aimed = (df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] for df in (corpus, aim))
    both = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(
        aim.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0 for c in "st")
    return both.select("bucket", F.floor(1000 * F.log(t * F.lit(size + buckets) / (s * F.lit(aimed + buckets)))).cast("long").alias("gain"))


def _draw(doc_id: Column, seed: int) -> Column:
    """Seeded Gumbel noise of an id in thousandths, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", *, runs: int = RUNS,
             buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_features, weight, score, rank).

    Of the rows with ``min_words`` words or more, ``percent`` percent are drawn by highest score, ties to the smaller id;
    ``rank`` counts them from 1 and is null for the others. Null and empty texts have no features and weigh 0. Every row
    is a document of its own: repeated rows count again and take neighbouring ranks in any order; a null id draws as
    the word null and comes last among ties. Without a target all is weighed against a flat distribution. Counts and
    ranks cover all rows; one number a bucket is sent to tasks. Empty tables give an empty result; other columns are ignored.
    """
    gain = np.zeros(buckets, np.int64)
    for row in cut(gains(docs, target, text_col, target_text, runs, buckets)).toLocalIterator():  # ``buckets`` rows
        gain[row["bucket"]] = row["gain"]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            n_words, owner, bucket = feature_buckets(list(batch["text"]), runs, buckets)
            n = np.bincount(owner, minlength=len(batch))
            total = np.bincount(owner, weights=gain[bucket], minlength=len(batch)).astype(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n_words, "n_features": n, "weight": total // np.maximum(n, 1)})

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weighed = slim.mapInPandas(weigh, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    weighed = cut(weighed.withColumn("score", F.col("weight") + _draw(F.col("doc_id"), seed)))
    may = F.col("n_words") >= min_words
    drawn = weighed.where(may).count() * percent // 100
    # Rows alike in score and id are interchangeable; the last key keeps a heap of them from meeting in one range.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    placed = ranked(weighed.where(may).withColumn("_row", F.monotonically_increasing_id()), order, "_place").drop("_row")
    placed = placed.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("long")).drop("_place")
    return placed.unionByName(weighed.where(~may).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
