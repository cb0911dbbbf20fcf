"""Upsert of typed tenders on their key, as one batch or as a growing change log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from bidlens.operators.catalog import newest

KEY, TITLE = "icz", "object_name"
REQUIRED = ["start_date_time", "end_date_time", "results_date", "initial_price"]


def checked(rows: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Add ``error``: why a row cannot be stored, null if it can."""
    needs = [c for c in (REQUIRED if required is None else required) if c in rows.columns]
    reason = F.when(F.coalesce(F.col(KEY), F.lit("")) == "", "missing id").when(
        F.coalesce(F.col(TITLE), F.lit("")) == "", "missing title"
    )
    for c in needs:
        reason = reason.when(F.col(c).isNull(), f"missing {c}")
    return rows.withColumn("error", reason)


def upsert(target: DataFrame, incoming: DataFrame, order: list[str], required: list[str] | None = None) -> DataFrame:
    """Target with the last valid incoming row of each key in place of the old one."""
    columns = target.columns
    valid = checked(incoming, required).filter("error is null")
    fresh = newest(valid.select(*columns, *[c for c in order if c not in columns]), KEY, order).select(*columns)
    is_new = F.col("_fresh")
    marked = target.alias("old").join(fresh.withColumn("_fresh", F.lit(True)).alias("new"), KEY, "full_outer")
    rest = [c for c in columns if c != KEY]
    return marked.select(
        KEY, *[F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest]
    ).select(*columns)


def upsert_stats(target: DataFrame, incoming: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row (created, updated, errors): the first valid row of an unknown key creates, all others update."""
    seen = checked(incoming, required)
    known = target.select(KEY, F.lit(True).alias("_known"))
    # Counted per key first, so a hot key reaches the join as one row.
    per_key = seen.groupBy(F.when(F.col("error").isNull(), F.col(KEY)).alias(KEY)).agg(
        F.sum(F.col("error").isNull().cast("long")).alias("valid"), F.sum(F.col("error").isNotNull().cast("long")).alias("bad")
    )
    created = F.when((F.col("valid") > 0) & F.col("_known").isNull(), 1).otherwise(0)
    out = per_key.join(known, KEY, "left").agg(
        F.sum(created).alias("created"), (F.sum("valid") - F.sum(created)).alias("updated"), F.sum("bad").alias("errors")
    )
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("created", "updated", "errors")])


def append_changes(path: str, incoming: DataFrame, batch_id: int, order: list[str], required: list[str] | None = None) -> None:
    """Add one batch to the change log. Writing a batch again replaces it, so a retry changes nothing."""
    valid = checked(incoming, required).filter("error is null").drop("error")
    newest(valid, KEY, order).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def current_state(changes: DataFrame, order: list[str]) -> DataFrame:
    """Newest row per key over all batches."""
    return newest(changes, KEY, ["batch_id", *order])


# A compacted log: ``base/at=<version>/bucket=<n>`` and ``manifest/version=<version>`` beside the batches. A manifest is one
# small file that appears at once and names, per bucket, the version whose files hold it and the last batch taken in.
BUCKETS = 16
MANIFEST = "bucket int, at long, last_batch long, version long"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest manifest, or ``None`` before the first compaction."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest_ = found.agg(F.max("version")).first()[0]
    return found.filter(F.col("version") == newest_) if newest_ is not None else None


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
    """(open batches, base rows with their bucket, manifest, last batch that the base holds)."""
    changes = spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log")
    manifest = _manifest(spark, path)
    if manifest is None:
        return changes, None, None, -(1 << 62)
    rows = manifest.collect()  # one row per bucket
    held = F.lit(False)
    for at in sorted({r["at"] for r in rows}):
        held = held | ((F.col("at") == at) & F.col("bucket").isin([r["bucket"] for r in rows if r["at"] == at]))
    last = rows[0]["last_batch"]
    return changes.filter(F.col("batch_id") > last), spark.read.parquet(f"{path}/base").filter(held), manifest, last


def compact(spark: SparkSession, path: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Take the open batches of a log at ``path`` into its base.

    Only buckets that the batches touch are written, as files of a new version; then the
    manifest names them. A reader sees the old manifest or the new one. A compaction that
    fails leaves files no manifest names, and is simply run again.
    """
    changes, base, manifest, last = _parts(spark, path)
    upto = changes.agg(F.max("batch_id")).first()[0]
    if upto is None:
        return
    version = upto
    taken = changes.filter(F.col("batch_id") <= upto).withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in taken.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    rows = taken if base is None else taken.unionByName(base.filter(F.col("bucket").isin(touched)).drop("at"))
    merged = newest(rows, KEY, ["batch_id", *order])
    merged.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/at={version}")
    kept = [] if manifest is None else [(r["bucket"], r["at"], upto, version) for r in manifest.filter(~F.col("bucket").isin(touched)).collect()]
    named = [(b, version, upto, version) for b in touched] + kept
    spark.createDataFrame(named, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def compacted_state(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """Newest row per key from the base and the open batches only."""
    changes, base, _, _ = _parts(spark, path)
    rows = changes if base is None else changes.unionByName(base.drop("at", "bucket"))
    return newest(rows, KEY, ["batch_id", *order])
