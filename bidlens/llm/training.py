"""Bounded samples of labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidlens.llm.common import held_out

_STEPS = 1_000_000


def labelled_sample(labels: DataFrame, label: Column, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, weight): about ``rows`` labelled ids of each class, chosen by hash, none held out.

    ``weight`` restores the classes' true shares. A class with fewer rows gives all it has.
    Ids are unique: of an id with several labels the largest counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), label.cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    # One row per class.
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept, weight = F.lit(0), F.lit(1.0)
    for value, n in sorted(sizes.items()):
        share = min(_STEPS, -(-rows * _STEPS // n))
        kept = F.when(F.col("label") == value, share).otherwise(kept)
        weight = F.when(F.col("label") == value, _STEPS / share).otherwise(weight)
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < kept).withColumn("weight", weight)


def sampled_texts(texts: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label, weight) of the sample; ``sample`` is bounded by its parameter, so it is sent to all tasks."""
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label", "weight")
