"""Column statistics, exact quantiles and ranks that never gather a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from bidlens.functions.vectors import doubles
from bidlens.session import materialise, task_slots

# Values a final refinement step may bring to the driver.
FINAL_VALUES = 100_000
BUCKETS = 4096


def field_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, min, max, mean, std, count): one pass, partial aggregates only.

    One value has std 1; a field without values counts as 0, 1, 0, 1, 0.
    """
    aggs: list[Column] = []
    for f in fields:
        n = F.count(f)
        aggs.append(
            F.struct(
                F.lit(f).alias("field"),
                F.coalesce(F.min(f).cast("double"), F.lit(0.0)).alias("min"),
                F.coalesce(F.max(f).cast("double"), F.lit(1.0)).alias("max"),
                F.coalesce(F.avg(f), F.lit(0.0)).alias("mean"),
                F.when(n <= 1, F.lit(1.0)).otherwise(F.stddev_pop(f)).alias("std"),
                n.alias("count"),
            ).alias(f)
        )
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`{f}`") for f in fields])))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Linear-interpolation quantiles of a whole column. Null and NaN do not count."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [math.nan] * len(probabilities)
    ranks = {r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
    found = _values_at(values, ranks, _Range(low, high, 0, n))
    out = []
    for p in probabilities:
        place = p * (n - 1)
        a, b = found[math.floor(place)], found[math.ceil(place)]
        out.append(a + (b - a) * (place - math.floor(place)))
    return out


@dataclass(frozen=True)
class _Range:
    """Values from low to high: how many lie below, how many inside."""

    low: float
    high: float
    below: int
    inside: int


def _values_at(values: DataFrame, ranks: set[int], span: _Range) -> dict[int, float]:
    """Order statistics: histogram passes narrow the ranges that hold the ranks.

    All ranks of a range share its pass. A range with few values is counted value
    by value; one value repeated without end is a range of width 0.
    """
    if span.low == span.high:
        return dict.fromkeys(ranks, span.low)
    held = values.filter(F.col("v").between(span.low, span.high))
    if span.inside <= FINAL_VALUES:
        rows = [(r["v"], r["v"], r["n"]) for r in held.groupBy("v").agg(F.count("v").alias("n")).orderBy("v").collect()]
    else:
        width = (span.high - span.low) / BUCKETS
        bucket = F.least(F.floor((F.col("v") - span.low) / width), F.lit(BUCKETS - 1))
        counts = held.groupBy(bucket.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = [(r["lo"], r["hi"], r["n"]) for r in counts.orderBy("b").collect()]
    found: dict[int, float] = {}
    below = span.below
    for low, high, n in rows:
        here = {r for r in ranks if below <= r < below + n}
        if here:
            found.update(_values_at(values, here, _Range(low, high, below, n)))
        below += n
    return found


def vector_summary(rows: DataFrame, group: str | None, vec_col: str) -> DataFrame:
    """(group, size, mean, std): population statistics per position, merged from per-task partial sums."""
    shape = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(doubles(F.col(vec_col)))).alias("s")
    out = (rows.groupBy(group) if group else rows.groupBy()).agg(shape)
    n = F.col("s.count").cast("double")
    return out.select(
        *([group] if group else []), F.col("s.count").alias("size"), vector_to_array("s.mean").alias("mean"),
        F.transform(
            vector_to_array("s.variance"), lambda x: F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), x * (n - 1) / n))).otherwise(0.0)
        ).alias("std"),
    )


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hits: Column | None = None) -> DataFrame:
    """Rank within ``keys`` without one task per key.

    A range partitioning over keys and order splits a hot key over many tasks;
    each task numbers its own rows and starts after the rows of the tasks before
    it. With ``hits`` (0/1) the running number of hits is added too.
    """
    parts = 4 * task_slots(df.sparkSession)
    marked = df if hits is None else df.withColumn("_hit", hits.cast("long"))
    spread = marked.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    # Written down, so that a lost task cannot bring other partition numbers.
    spread = materialise(spread.withColumn("_part", F.spark_partition_id()), "ranked")
    sums = [F.count(F.lit(1)).alias("_n")] + ([] if hits is None else [F.sum("_hit").alias("_h")])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(*keys, "_part").agg(*sums)
    starts = starts.withColumn("_rows_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if hits is not None:
        starts = starts.withColumn("_hits_before", F.coalesce(F.sum("_h").over(before), F.lit(0)))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    out = spread.join(starts.drop("_n", "_h"), [*keys, "_part"])
    out = out.withColumn("rank", F.row_number().over(local) + F.col("_rows_before"))
    if hits is not None:
        running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("hits", F.sum("_hit").over(running) + F.col("_hits_before"))
    return out.drop("_part", "_rows_before", "_hits_before", "_hit")
