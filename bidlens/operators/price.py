"""Price prediction from the neighbours of a tender.

Input rows are the result of a top-k search, so a group has at most k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

METHODS = ["mean", "median", "weighted_median", "min", "max", "mode"]


def _rounded(c: Column) -> Column:
    return F.round(c, 9)


def weighted_median(neighbours: DataFrame, query_col: str, price: str = "price", score: str = "score", tie: str = "tender_id") -> DataFrame:
    """First price whose share of the total score, cheapest first, reaches one half."""
    group = Window.partitionBy(query_col)
    running = group.orderBy(price, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, n = F.sum(score).over(group), F.count(F.lit(1)).over(group)
    weight = F.when(total > 0, F.try_divide(F.col(score), total)).otherwise(F.lit(1.0) / n)
    ranked = neighbours.withColumn("_w", weight).withColumn("_cum", F.sum("_w").over(running))
    return ranked.groupBy(query_col).agg(
        F.coalesce(
            F.min(F.when(_rounded(F.col("_cum")) >= 0.5, F.col(price))), F.percentile(price, F.lit(0.5))
        ).alias("predicted_price")
    )


def mode(neighbours: DataFrame, query_col: str, price: str = "price") -> DataFrame:
    """Midpoint of the fullest histogram bin, bin width chosen from spread and count."""
    shape = neighbours.groupBy(query_col).agg(
        F.count(price).alias("n"), F.min(price).alias("low"), F.max(price).alias("high"),
        (F.percentile(price, F.lit(0.75)) - F.percentile(price, F.lit(0.25))).alias("iqr"),
    )
    n, span = F.col("n").cast("double"), F.col("high") - F.col("low")
    by_spread = F.greatest(2.0 * F.col("iqr") * F.pow(n, F.lit(-1.0 / 3.0)), span / F.sqrt(n) / 2.0)
    by_count = span / (F.log2(n) + 1.0)
    bins = F.when(span > 0, F.ceil(_rounded(span / F.least(by_spread, by_count)))).otherwise(F.lit(1)).cast("double")
    shape = shape.withColumn("bins", bins).withColumn("step", F.col("high") / F.col("bins") - F.col("low") / F.col("bins"))
    place = F.when(F.col("step") > 0, F.least(F.floor((F.col(price) - F.col("low")) / F.col("step")), F.col("bins") - 1)).otherwise(F.lit(0.0))
    counted = (
        neighbours.join(shape, query_col).withColumn("bin", place.cast("double"))
        .groupBy(query_col, "low", "step", "bin").agg(F.count(F.lit(1)).alias("held"))
    )
    fullest = F.min(F.struct((-F.col("held")).alias("neg"), "bin", "low", "step"))
    best = counted.groupBy(query_col).agg(fullest.alias("b"))
    return best.select(query_col, (F.col("b.low") + (F.col("b.bin") + 0.5) * F.col("b.step")).alias("predicted_price"))


def confidence(n: Column, low: Column, high: Column) -> Column:
    spread = F.when(high > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(high - low, high))).otherwise(F.lit(0.5))
    enough = 0.7 * F.least(n / 10.0, F.lit(1.0)) + 0.3 * spread
    value = F.when(n >= 3, enough).otherwise(0.3 * (n / 3.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def predict(neighbours: DataFrame, query_col: str, method: str = "weighted_median", price: str = "price", score: str = "score") -> DataFrame:
    """One row per query: prediction, confidence, price range, neighbours used and found.

    ``price`` is null where no positive price could be read; such rows count as found only.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    usable = neighbours.filter(F.col(price).isNotNull())
    summary = neighbours.groupBy(query_col).agg(
        F.count(price).alias("used"), F.count(F.lit(1)).alias("total"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.avg(price).alias("_mean"), F.percentile(price, F.lit(0.5)).alias("_median"),
    )
    if method in ("weighted_median", "mode"):
        chosen = weighted_median(usable, query_col, price, score) if method == "weighted_median" else mode(usable, query_col, price)
        summary = summary.join(chosen, query_col, "left")
    else:
        column = {"mean": "_mean", "median": "_median", "min": "min_price", "max": "max_price"}[method]
        summary = summary.withColumn("predicted_price", F.col(column))
    used = F.col("used").cast("double")
    sure = F.when(F.col("used") > 0, confidence(used, F.col("min_price"), F.col("max_price"))).otherwise(F.lit(0.0))
    return summary.select(
        query_col, F.col("predicted_price"), F.lit(method).alias("method"), sure.alias("confidence"),
        "min_price", "max_price", "used", "total",
    )
