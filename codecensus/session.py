"""Session helpers: tuned local session, reliable checkpoints, size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "codecensus") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Truncate lineage by writing to the reliable checkpoint folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Add a broadcast hint only after seeing that the side is small.

    The probe reads at most ``max_rows + 1`` rows; beyond the bound the plain side
    comes back and the join runs as a shuffle join with adaptive skew handling.
    """
    probe = df.select(F.lit(1)).limit(max_rows + 1).count()
    return F.broadcast(df) if probe <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join in which both may grow with the input: rows are moved by key and merged.

    Before it runs, a table is taken to be as large as the compressed columns it is read from. Exploded rows or built
    texts then look small enough to broadcast, which brings them whole to the driver, however many there are.
    """
    return df.hint("merge")


def once(value: Column, name: str) -> Column:
    """A column for ``select`` that is worked out once a row, however often later steps read it.

    The optimizer moves a filter below the projection it reads from and repeats its expressions there, and again for every
    ``explode`` of one; a costly fold or scan then runs several times a row. What a generator puts out is not repeated.
    """
    return F.explode_outer(F.array(value)).alias(name)


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write once as Parquet below the checkpoint folder and read back.

    Unlike a checkpoint the result keeps column pruning and filter pushdown, so a wide
    table (such as file texts) can serve many readers that each need little of it.
    """
    import uuid

    spark = df.sparkSession
    _checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_round(df: DataFrame) -> DataFrame:
    """Truncate lineage in a loop, by a written table.

    A checkpoint keeps the size its plan was estimated at. A join is estimated at the product of its sides, so in a loop
    of joins that number grows without bound, planning with it, and no side ever looks small enough to broadcast. A
    written table has the size it has.
    """
    return stored(df)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a CPU-heavy pass over few input splits.

    A table written as one row group arrives in one task. Only when the scan has fewer
    splits than the cluster has cores are the rows dealt out; a large input, which has
    many splits anyway, is never shuffled. Apply to a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores * 2) if splits < cores else df
