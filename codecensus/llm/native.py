"""Word and shingle hashes as column expressions, and exact containment of small texts in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codecensus.session import cut

SHINGLE = 5
#: Most rows of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column, gap: str = r"[\x20\x09-\x0D]+") -> Column:
    """Lower-cased words of a whole text: what stands between the gaps."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), gap), "")


def hashes(items: Column) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def shingle_hashes(word_hashes: Column, size: int = SHINGLE, whole: bool = False) -> Column:
    """Hash of every run of ``size`` words. Fewer words have none, or with ``whole`` one: their whole sequence.

    Name a column: an expression would be computed again for every run.
    """
    starts = F.when(F.size(word_hashes) >= size, F.sequence(F.lit(0), F.size(word_hashes) - size)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(size)]))
    return F.when(F.size(word_hashes).between(1, size - 1), F.array(F.xxhash64(word_hashes))).otherwise(runs) if whole else runs


def exploded(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row for each item of a computed array.

    A plain explode lets the optimizer repeat the whole computation in a "has elements" filter below it.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table that has been counted and is small; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def weighted_shingles(texts: DataFrame, id_col: str, text_col: str, name: str, gap: str, size: int = SHINGLE, whole: bool = False) -> DataFrame:
    """(name, x, weight): distinct shingles of small texts; a shingle that d texts hold weighs 1000 / d, rounded down, and 1 at least."""
    hashed = texts.select(F.col(id_col).alias(name), hashes(words(F.col(text_col), gap)).alias("h"))
    each = exploded(hashed, F.array_distinct(shingle_hashes(F.col("h"), size, whole)), "x", name).distinct()
    held = each.groupBy("x").agg(F.count("*").alias("d"))
    return each.join(held, "x").select(name, "x", F.greatest(F.lit(1), F.floor(F.lit(1000) / F.col("d"))).cast("long").alias("weight"))


def contained(docs: DataFrame, pairs: DataFrame, parts: DataFrame, name: str, gap: str, percent: int, size: int = SHINGLE, whole: bool = False) -> DataFrame:
    """(_id, name, shared, total): the pairs whose small text lies in the document with ``percent`` of its weight or more.

    docs: (_id, text); pairs: (_id, name); parts: weighted_shingles. Exact; only documents that a pair names are read.
    """
    ids = cut(pairs.select(F.col("_id").alias("_want")).distinct())
    asked = docs.join(bounded(ids), F.expr("_id <=> _want"), "left_semi").select("_id", hashes(words(F.col("text"), gap)).alias("h"))
    held = exploded(asked, F.array_distinct(shingle_hashes(F.col("h"), size, whole)), "x", "_id")
    total = parts.groupBy(name).agg(F.sum("weight").alias("total"))
    # Rows that repeat an id are one document: a shingle counts once.
    found = held.join(bounded(parts), "x").select("_id", name, "x", "weight").distinct().groupBy("_id", name).agg(F.sum("weight").alias("shared"))
    found = found.join(bounded(total), name).where(100 * F.col("shared") >= percent * F.col("total")).alias("f")
    return found.join(pairs.alias("p"), F.expr(f"f._id <=> p._id and f.{name} = p.{name}"), "left_semi")
