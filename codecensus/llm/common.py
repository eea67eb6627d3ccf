"""Helpers the training-data operators share: words, shingle hashes, connected classes, ranks, the query registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codecensus.session import cut

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """Hash of each word, kept while a task meets the word again; it forgets all when it has grown large."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


#: Rows that a task holds in worked-up form at a time; a batch from the JVM has many more.
SLICE = 500


def slices(batches: Iterator[pd.DataFrame | pd.Series]) -> Iterator[pd.DataFrame | pd.Series]:
    """Batches in small pieces, so that a task's memory follows a few texts and not a whole batch."""
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            yield batch.iloc[k : k + SLICE].reset_index(drop=True)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str | None, seen: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text, A-Z lower-cased.

    A text of fewer than ``size`` words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    span = min(size, len(words))
    n = len(words) - span + 1
    rolled = np.full(n, span, np.uint64)
    for k in range(span):
        rolled = rolled * MULTIPLIER + hashes[k : k + n]
    return np.unique(mixed(rolled))


#: Rows of ids and signatures that make a task worth its files and its log entry.
TASK_ROWS = 20_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """No more partitions than cores, or than ``rows`` rows need.

    A shuffle leaves as many partitions as the session asks for. A table of few rows then costs a task, an entry in the log
    and, when it is kept or shuffled again, small files for each of them.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Class of each node of an undirected graph: (node, component), component the smallest node of the class.

    Large-star and small-star rounds on the edge list: every step is a minimum per node and a join, so a hub of
    any degree is pre-aggregated and never gathered; rounds grow with the logarithm of the longest path. No round has more
    edges than the one before it, so its tables are packed by that number. It ends when all classes are stars, which one
    sum per node tells: edges that are stars from the start take no round at all.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = cut(e)
    while True:
        # In stars no node has two smaller neighbours, or both a smaller and a larger one.
        ends = e.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        sums = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
        n, bent = sums.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        if not bent:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        e = packed(e, n)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = packed(both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")), n)
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(packed(packed(small.union(down.select("hi", F.col("m").alias("lo"))), n).distinct(), n))


def ranked(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Number the rows 0, 1, ... in the given order without bringing them into one task.

    Rows are dealt out by range, numbered inside each range, and each range adds the sizes of those before it. Only
    the range sizes meet in one place.
    """
    from pyspark.sql import Window

    parts = cut((df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return parts.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_part").withColumn(
        name, (F.col("_start") + F.col("_in")).cast("long")).drop("_part", "_in", "_start")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, columns)
