"""Continuous ingest: raw tenders arrive as files and end up in the change log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from bidlens.sources.upsert import append_changes, current_state


def stream_upsert(
    spark: SparkSession, source: str, schema: T.StructType, to_typed: Callable[[DataFrame], DataFrame], log_path: str,
    checkpoint: str, order: list[str], fmt: str = "parquet", files_per_batch: int = 1000, glob: str | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """Take in all files not yet seen and return the current table.

    A micro-batch writes only its own rows, under its batch number; run again
    after a failure it replaces them. The source position is in ``checkpoint``.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def store(batch: DataFrame, batch_id: int) -> None:
        append_changes(log_path, to_typed(batch), batch_id, order, required)

    # An empty first batch gives the log its schema before any file arrives.
    append_changes(log_path, to_typed(spark.createDataFrame([], schema)), -1, order, required)
    query = (
        reader.load(source).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return current_state(spark.read.parquet(log_path), order)
