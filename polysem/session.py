"""Session helpers: shared scratch space, lineage cuts and size checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest table, in bytes, that this package lets Spark broadcast. What grows
# with the data goes through `fits` first; tables of a row per partition, block
# or language, and those bounded by a parameter, say so where they are made.
BROADCAST_LIMIT = 256 * 1024 * 1024


def get_spark(app: str = "polysem", cores: str | int = "*") -> SparkSession:
    """A local session with the settings the package is tuned for; a cluster
    submits its own session and these defaults do not apply."""
    cpus = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. A cluster must name it in
    `spark.checkpoint.dir`; only a session that is one process (tests) makes a
    local one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="polysem-"))
    return named or context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder in the shared space."""
    return f"{shared_dir(spark).rstrip('/')}/polysem/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably and forget how it was computed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` as parquet into the shared folder and read it back: a lineage
    cut that keeps column and partition pruning."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(rows: int, row_bytes: int) -> bool:
    """Whether a table of `rows` x `row_bytes` may be broadcast."""
    return rows * row_bytes <= BROADCAST_LIMIT


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of a few unsplittable files the parallelism of the cluster.
    A scan that already has enough partitions is returned as it is."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
