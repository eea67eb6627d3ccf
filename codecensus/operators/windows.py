"""Ordered-group operators that stay bounded when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codecensus.session import broadcast_if_small, cut

Keys = list[str]
GROUP_LIMIT = 1000
SLICES = 64


def _cols(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in (order if isinstance(order, (list, tuple)) else [order])]


def top_per_group(df: DataFrame, keys: Keys, order, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every group.

    ``row_number() <= n`` lets Spark cut each group to n rows before the shuffle
    (window group limit), so a hot group ships n rows per task and no more.
    """
    name = rank or "__rn"
    if n > GROUP_LIMIT:
        # Beyond Spark's threshold the cut before the shuffle does not apply: deal every group
        # out over slices, cut each slice to n, and only rank what is left.
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
        salt = F.pmod(F.xxhash64(*plain) if plain else F.monotonically_increasing_id(), F.lit(SLICES))
        part = W.partitionBy(*keys, "__salt").orderBy(*_cols(order))
        df = df.withColumn("__salt", salt).withColumn("__pre", F.row_number().over(part)).where(F.col("__pre") <= n).drop("__salt", "__pre")
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*_cols(order)))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_wins(df: DataFrame, keys: Keys, order) -> DataFrame:
    """The earliest row per key."""
    return top_per_group(df, keys, order, 1)


def capped_list(df: DataFrame, keys: Keys, order, item: Column, n: int, name: str) -> DataFrame:
    """Ordered array of the first ``n`` items per group."""
    kept = top_per_group(df.withColumn("__item", item), keys, order, n, rank="__rk")
    pairs = F.array_sort(F.collect_list(F.struct("__rk", "__item")))
    return kept.groupBy(*keys).agg(F.transform(pairs, lambda p: p["__item"]).alias(name))


def forward_fill(
    df: DataFrame, keys: Keys, order: str, value: str, out: str, chunk: Column | None = None, chunk_rows: int = 65536
) -> DataFrame:
    """Last non-null ``value`` at or before each row, per key, in ``order``.

    Two levels keep a hot key parallel: rows fill inside a (key, chunk) window, one carry
    per chunk is computed over chunk summaries only, and joined back. ``chunk`` must not
    decrease with ``order``; by default ``order`` is an integer position.
    """
    part = chunk if chunk is not None else F.floor(F.col(order) / F.lit(chunk_rows))
    rows = df.withColumn("__chunk", part)
    local = W.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = rows.withColumn("__local", F.last(value, ignorenulls=True).over(local))
    tails = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, "__chunk")
        .agg(F.max_by(value, order).alias("__tail"))
    )
    present = rows.select(*keys, "__chunk").distinct()
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        present.join(tails, [*keys, "__chunk"], "left")
        .withColumn("__carry", F.last("__tail", ignorenulls=True).over(before))
        .where(F.col("__carry").isNotNull())
        .select(*keys, "__chunk", "__carry")
    )
    return (
        filled.join(carry, [*keys, "__chunk"], "left")
        .withColumn(out, F.coalesce("__local", "__carry"))
        .drop("__chunk", "__local", "__carry")
    )


def fold_other(df: DataFrame, keys: Keys, label: str, value: str, limit: int = 8) -> DataFrame:
    """Keep the ``limit - 1`` largest labels of a group and sum the rest as 'Other (k)'.

    Groups of at most ``limit`` labels stay as they are. The rest is total minus kept, so
    only ``limit`` labels per group are ever ranked.
    """
    summed = df.groupBy(*keys, label).agg(F.sum(value).alias(value))
    top = top_per_group(summed, keys, [F.desc(value), label], limit, rank="rank")
    sizes = summed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__all"))
    held = top.where(F.col("rank") < limit).groupBy(*keys).agg(F.sum(value).alias("__held"))
    wide = sizes.where(F.col("__n") > limit)
    rest = wide.join(held, keys).select(
        *keys,
        F.format_string("Other (%d)", F.col("__n") - limit + 1).alias(label),
        (F.col("__all") - F.col("__held")).alias(value),
        F.lit(limit).alias("rank"),
    )
    small = (
        top.join(wide.select(*keys, F.lit(True).alias("__wide")), keys, "left")
        .where(F.col("__wide").isNull() | (F.col("rank") < limit))
        .select(*keys, label, value, "rank")
    )
    return small.unionByName(rest)


def with_overflow(df: DataFrame, keys: Keys, label: str, order, shown: int = 16) -> DataFrame:
    """Shown labels of a group plus one '+n more' row when some are left out."""
    top = top_per_group(df, keys, order, shown, rank="rank").select(*keys, label, "rank")
    more = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > shown)
        .select(*keys, F.format_string("+%d more", F.col("__n") - shown).alias(label), F.lit(shown + 1).alias("rank"))
    )
    return top.unionByName(more)


def merge_smallest(df: DataFrame, keys: Keys, label: str, size: str, limit: int = 40) -> DataFrame:
    """Beyond ``limit`` rows per group, everything after the largest ``limit - 1`` becomes '(other)'."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__all"))
    top = top_per_group(df.select(*keys, label, size), keys, [F.desc(size), label], limit, rank="__rk").join(counts, keys)
    kept = top.where((F.col("__n") <= limit) | (F.col("__rk") < limit))
    merged = (
        kept.where(F.col("__n") > limit).groupBy(*keys, "__n", "__all").agg(F.sum(size).alias("__held"))
        .select(*keys, F.lit("(other)").alias(label), (F.col("__all") - F.col("__held")).alias(size),
                (F.col("__n") - limit + 1).alias("merged"))
    )
    return kept.select(*keys, label, size, F.lit(0).cast("long").alias("merged")).unionByName(merged)


def merge_evidence(df: DataFrame, keys: Keys, order, file="file", line="line", snippet="snippet", limit: int = 8) -> DataFrame:
    """Distinct (file, line, snippet) per group, first ``limit`` in order."""
    once = first_wins(df, [*keys, file, line, snippet], order)
    return top_per_group(once, keys, order, limit, rank="rank")


def numbered(df: DataFrame, keys: Keys, order: list, name: str = "n") -> DataFrame:
    """Global 0-based position per group without one task per group.

    Rows are range-partitioned by (keys, order); a partition's offset is the number of
    the group's rows in earlier partitions, so only counts meet, never the rows.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut(df.repartitionByRange(width, *cols).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__off", F.coalesce(F.sum("__c").over(W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    local = placed.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__p").orderBy(*cols[len(keys):])))
    return local.join(broadcast_if_small(before), [*keys, "__p"]).withColumn(name, (F.col("__off") + F.col("__r") - 1).cast("long")).drop("__p", "__off", "__r")


def select_by(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose named columns hold one of the given values: point look-ups by id, kind, severity and so on.

    The filters reach the scan. None asks for nothing; an empty list finds nothing.
    """
    for name, values in wanted.items():
        if values is not None:
            df = df.where(F.col(name).isin(*([values] if isinstance(values, (str, int)) else values)))
    return df
