"""Session set-up, shared scratch folder and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows a query-side table may have before it is no longer sent to every task.
MAX_BROADCAST_ROWS = 4096


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bidlens")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session.

    Only a local session without the setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="bidlens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


# With it Spark removes what a query has shuffled when the query ends, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, leaves no shuffled files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int = MAX_BROADCAST_ROWS):
    """The table as pandas if it has at most ``limit`` rows, else ``None``."""
    head = df.limit(limit + 1).toPandas()
    return head if len(head) <= limit else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table in fewer files than task slots, spread for costly row work.

    A table of many files is left as it is: its scan has tasks enough.
    """
    slots = task_slots(df.sparkSession)
    return df.repartition(slots, key) if len(df.inputFiles()) < slots else df


def small_side(df: DataFrame, name: str, limit: int = 10 * MAX_BROADCAST_ROWS) -> DataFrame:
    """A summary table for a join: written once, sent to every task only if its row count allows.

    Beyond the bound the join is left to Spark, which shuffles both sides.
    """
    kept = materialise(df, name)
    return F.broadcast(kept) if kept.count() <= limit else kept


def task_slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
