"""Views over the driver tables that several queries share."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bidlens.functions.vectors import doubles
from bidlens.operators.clusters import centroids
from bidlens.plans.tenders import (
    PRIORITY_GROUPS, district_groups, order_tenders, prepared, table,
)
from bidlens.session import materialise, task_slots

NEW_DAYS = 7

# Prepared tenders are written once per application and table folder, the way a
# search service loads its history once.
_prepared: dict[tuple[str, str], DataFrame] = {}


def prepared_tenders(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _prepared:
        n = table(spark, sf, "orders").count()
        rows_per_file = max(10_000, min(1_000_000, n // (2 * task_slots(spark))))
        _prepared[key] = materialise(prepared(order_tenders(spark, sf)), "tenders", rows_per_file)
    return _prepared[key]


def new_and_history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tenders of the newest week and all earlier ones."""
    tenders = prepared_tenders(spark, sf)
    since = tenders.agg(F.max("published")).first()[0] - timedelta(days=NEW_DAYS)
    return tenders.filter(F.col("published") > F.lit(since)), tenders.filter(F.col("published") <= F.lit(since))


def groups(spark: SparkSession, sf: str) -> dict:
    return {"districts": district_groups(spark, sf), "method_groups": PRIORITY_GROUPS}


def consecutive(spark: SparkSession, sf: str) -> DataFrame:
    """Each tender (t) with the one registered next (c): an equi join of unique keys."""
    tenders = prepared_tenders(spark, sf)
    row = F.struct(*tenders.columns)
    left = tenders.select(F.col("o_orderkey").alias("pair_id"), row.alias("t"))
    right = tenders.select((F.col("o_orderkey") - 1).alias("pair_id"), row.alias("c"))
    return left.join(right, "pair_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("vec"), "label"
    )


def noisy_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors where the rows of label 9 count as not clustered."""
    return vectors(spark, sf).withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label: its centroid."""
    return centroids(vectors(spark, sf)).select(F.col("label").alias("query_id"), F.col("centroid").alias("query_vec"))


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector (a) with the next one (b)."""
    rows = vectors(spark, sf)
    left = rows.select("id", F.col("vec").alias("a"))
    right = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b"))
    return left.join(right, "id")


def r6(c: Column, name: str) -> Column:
    """Computed double in the form both engines are compared in."""
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)
