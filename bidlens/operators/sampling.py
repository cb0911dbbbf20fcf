"""Stable hashes, splits and samples: the same rows on every run and after every retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRAINING_ROWS = 10_000


def hash_number(id_col: Column) -> Column:
    """32 bits of the md5 of an id, the same in every engine."""
    return F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long")


def split_column(id_col: Column, train_share: float = 0.9) -> Column:
    """'train' or 'test' by hash; needs no shuffle."""
    return F.when(F.pmod(hash_number(id_col), F.lit(100)) < int(round(train_share * 100)), "train").otherwise("test")


def hash_sample(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """n rows in hash order."""
    return df.orderBy(hash_number(F.col(id_col)), id_col).limit(n)


def training_sample(rows: DataFrame, id_col: str, n: int = TRAINING_ROWS) -> DataFrame:
    """At most n rows to train a model on; never results."""
    return hash_sample(rows, n, id_col)


def head_sample(df: DataFrame, n: int, id_col: str) -> DataFrame:
    return df.orderBy(id_col).limit(n)
