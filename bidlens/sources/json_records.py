"""Reading tender records out of JSON documents; writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bidlens.schema import ESSENTIAL_FIELDS


def read_json_records(
    spark: SparkSession, path: str, record: T.StructType, root_keys: Sequence[str] = ("tenders", "data", "results"),
    on_error: str = "empty", whole_files: bool = False,
) -> DataFrame:
    """Records of documents whose root is a list, an object holding a list, or one record.

    A document is a line, or a file with ``whole_files``. Unreadable documents
    give no rows (``on_error="empty"``) or end the job (``"raise"``). The schema is
    given, so nothing is read twice.
    """
    if on_error not in ("empty", "raise"):
        raise ValueError("on_error is 'empty' or 'raise'")
    lists = [T.StructField(k, T.ArrayType(record)) for k in root_keys]
    broken = T.StructField("_broken", T.StringType())
    schema = T.StructType([*record.fields, *lists, broken])
    docs = (
        spark.read.schema(schema)
        .option("multiLine", whole_files)
        .option("mode", "PERMISSIVE" if on_error == "empty" else "FAILFAST")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )
    own = F.array(F.struct(*[F.col(f"`{n}`") for n in record.fieldNames()]))
    held = F.coalesce(*[F.col(f"`{k}`") for k in root_keys], own)
    return docs.filter(F.col("_broken").isNull()).select(F.inline(held))


def essential(df: DataFrame, fields: Sequence[str] = tuple(ESSENTIAL_FIELDS)) -> DataFrame:
    """Only the fields a short result keeps, as far as the table has them."""
    return df.select(*[c for c in df.columns if c in fields])


def write_results(df: DataFrame, path: str, include_full: bool = True, keep: Sequence[str] = (), fmt: str = "json") -> None:
    out = df if include_full else df.select(*keep, *[c for c in df.columns if c in ESSENTIAL_FIELDS and c not in keep])
    out.write.format(fmt).mode("overwrite").save(path)
