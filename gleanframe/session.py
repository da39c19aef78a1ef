"""Session helpers: a tuned builder, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a cluster job wants. Nothing below depends on them for right results.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even where the next step then needs a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "gleanframe") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleanframe-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows that one task sorts or keeps in a hash table.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hash partitioned by ``keys``, with as many partitions as ``rows`` fill at ``TASK_ROWS`` each.

    Spark's own shuffles have a set number of partitions and are merged up to a number of compressed bytes,
    so what a task sorts or counts grows with the table; with a number of its own it does not. Where the
    rows fill no partition for every core, ``df`` is left to Spark. Sides of one join take the same ``rows``.
    A hot key stays in one partition.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def hashed(dim: DataFrame) -> DataFrame:
    """``dim`` for a join with facts that are not sorted: each task hashes its share of ``dim`` and reads the facts past it.

    A sort-merge join sorts the facts, in partitions that Spark merges up to a number of compressed bytes, so what a
    task holds grows with them. A table of ``TASK_ROWS`` rows or fewer is left to Spark, which may broadcast it. Spark
    still splits the facts of a hot key.
    """
    return dim.hint("shuffle_hash") if dim.count() > TASK_ROWS else dim


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there.

    Used where rows must stay where a first pass saw them (partition ids of a
    range partitioning) or where a loop would grow the plan.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read from there.

    Unlike a checkpoint its size is known, so Spark broadcasts it where it is small instead of shuffling what it is joined with.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
