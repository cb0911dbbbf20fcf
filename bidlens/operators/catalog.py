"""Filters and listings over the tender catalogue; all of them push down to the scan."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from datetime import date, datetime, timedelta
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from bidlens.functions.text import name_cut, strip


def apply_filters(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Before the search: equality, ``{"min", "max"}`` (both needed) or ``{"in": [...]}``."""
    for name, condition in (filters or {}).items():
        if isinstance(condition, Mapping) and not ({"min", "max"} <= set(condition) or "in" in condition):
            continue
        if name not in df.columns:
            return df.filter(F.lit(False))
        c = F.col(name)
        if not isinstance(condition, Mapping):
            df = df.filter(c == F.lit(condition))
        elif "min" in condition and "max" in condition:
            df = df.filter(c.between(F.lit(condition["min"]), F.lit(condition["max"])))
        else:
            df = df.filter(c.isin(list(condition["in"])))
    return df


def post_filter(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """After the search: equality or membership; a row without the field passes."""
    for name, value in (filters or {}).items():
        if name not in df.columns:
            continue
        c = F.col(name)
        hit = c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == F.lit(value)
        df = df.filter(c.isNull() | hit)
    return df


def has(c: Column, text: str) -> Column:
    """Contains, ignoring case; no wildcards."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def _day(text: str) -> date | None:
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        return None


def _amount(text: str) -> Decimal | None:
    try:
        value = Decimal(text)
    except InvalidOperation:
        return None
    return value if value.is_finite() else None


def search(
    catalog: DataFrame, region: str = "", procurement_method: str = "", stage: str = "", end_date_from: str = "",
    end_date_to: str = "", price_min: str = "", price_max: str = "", search: str = "",
) -> DataFrame:
    """Site filters; empty or unreadable input does not filter. The stage ignores case and outer spaces."""
    out = catalog
    if region:
        out = out.filter(has(F.col("region"), region))
    if procurement_method:
        out = out.filter(has(F.col("procurement_method"), procurement_method))
    if stage:
        out = out.filter(F.lower(strip(F.col("stage"))) == stage.strip().lower())
    first, last = _day(end_date_from), _day(end_date_to)
    if first:
        out = out.filter(F.col("end_date_time") >= F.lit(datetime.combine(first, datetime.min.time())))
    if last:
        out = out.filter(F.col("end_date_time") < F.lit(datetime.combine(last + timedelta(days=1), datetime.min.time())))
    low, high = _amount(price_min), _amount(price_max)
    if low is not None:
        out = out.filter(F.col("initial_price") >= F.lit(low))
    if high is not None:
        out = out.filter(F.col("initial_price") <= F.lit(high))
    if search:
        out = out.filter(
            has(F.col("object_name"), search) | has(F.col("customer_full_name"), search) | has(F.col("icz"), search)
        )
    return out


def filter_values(catalog: DataFrame, names: Iterable[str]) -> DataFrame:
    """(field, value): distinct lower-cased trimmed values, without empty ones, sorted."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.lower(F.trim(F.col(n))).alias("value")) for n in names])
    return catalog.select(F.inline(cells)).filter("value is not null and value != ''").distinct().orderBy("field", "value")


def listing(catalog: DataFrame) -> DataFrame:
    """Table view, latest end first."""
    return catalog.orderBy(F.col("end_date_time").desc_nulls_last(), "icz").select(
        "icz",
        name_cut(F.col("object_name"), 50).alias("title"),
        name_cut(F.col("customer_full_name"), 40).alias("customer"),
        "region",
        F.col("initial_price").cast("decimal(15,2)").cast("string").alias("price"),
        F.date_format("end_date_time", "dd.MM.yyyy HH:mm").alias("ends"),
        "stage",
    )


# Search criterion -> tender column.
CRITERIA = {
    "region": "region", "method": "method", "customer": "customer", "min_price": "price_text", "max_price": "price_text",
    "date_from": "published_text", "date_to": "published_text", "keywords": "title",
}


# Criteria one task puts in order.
TASK_CRITERIA = 1 << 19


def targets_from_criteria(criteria: DataFrame, query_col: str = "query", order_col: str = "ord") -> DataFrame:
    """Long (query, ord, key, value) rows -> one target per query; of two values for one column the later stays."""
    lookup = F.create_map(*[x for k, v in CRITERIA.items() for x in (F.lit(k), F.lit(v))])
    named = criteria.withColumn("field", F.try_element_at(lookup, F.col("key")))
    columns = list(dict.fromkeys(CRITERIA.values()))
    # Values of strings are reduced by sorting: dealt first, so that a task sorts no more where the table grows.
    parts = max(int(criteria.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(criteria.count() / TASK_CRITERIA))
    return named.repartition(parts, query_col).groupBy(query_col).agg(
        *[F.max_by(F.when(F.col("field") == c, F.col("value")), F.when(F.col("field") == c, F.col(order_col))).alias(c)
          for c in columns]
    )


def exclude_one_identical(candidates: DataFrame, targets: DataFrame, columns: list[str], order_col: str) -> DataFrame:
    """Drop one candidate, the first by ``order_col``, for each target content it equals.

    For targets without an id. Only a digest of the content moves; the first row
    per content comes from a partial aggregate, so many copies never meet in one
    task.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("_content")
    wanted = targets.select(digest).distinct()
    equal = candidates.select(order_col, digest).join(wanted, "_content", "left_semi")
    first = equal.groupBy("_content").agg(F.min(order_col).alias(order_col)).select(order_col)
    return candidates.join(first, order_col, "left_anti")


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key, by a partial aggregate instead of a sort of each group."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")
