"""Feature blocks: words, categories, numbers, dates."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from bidlens.functions.kernels import square_length
from bidlens.functions.text import clean_text, clean_words, words_of
from bidlens.functions.vectors import doubles
from bidlens.operators.sampling import hash_number
from bidlens.operators.stats import exact_quantiles, vector_summary
from bidlens.schema import EMBEDDING_FIELD_WEIGHTS


# Bytes of text whose words one task counts; it holds some twenty times as much.
TASK_TEXT = 16 << 20


def text_parts(df: DataFrame) -> int:
    """Partitions for counting words, so that a task's share does not grow with the table."""
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(0)))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_TEXT))


def encode_words(df: DataFrame, id_col: str, text: Column, parts: int | None = None) -> DataFrame:
    """(id, token, n, weight): word counts of a text and their share of its length-1 vector.

    Texts move once, to their id; both aggregations then work in place.
    """
    held = [id_col, *[c for c in df.columns if c != id_col]]
    words = df.select(*held).repartition(parts or text_parts(df), id_col).select(id_col, F.explode(words_of(text)).alias("token"))
    counts = words.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(id_col)))
    return counts.withColumn("weight", F.col("n") / size)


def hashed_words(text: Column, dims: int) -> Column:
    """Fixed-width word counts of a short text: a word adds to the slot its hash names."""
    slots = F.transform(words_of(text), lambda w: F.pmod(hash_number(w), F.lit(dims)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"),
    )


def encode_distinct(df: DataFrame, id_col: str, text_col: str, prepare: Callable[[Column], Column] = clean_text) -> DataFrame:
    """(id, text_key, terms, length): each distinct text is cleaned and encoded once, then joined back."""
    keyed = df.select(id_col, text_col, F.md5(text_col).alias("text_key"))
    once = keyed.groupBy("text_key").agg(F.first(text_col).alias(text_col))
    counts = encode_words(once, "text_key", prepare(F.col(text_col)), text_parts(df.select(text_col)))
    summary = counts.groupBy("text_key").agg(
        F.count(F.lit(1)).alias("terms"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length")
    )
    return keyed.select(id_col, "text_key").join(summary, "text_key", "left").select(
        id_col, "text_key", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("length", F.lit(0.0)).alias("length")
    )


def composite_embedding(df: DataFrame, id_col: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(id, token, weight): weighted mean of the unit word vectors of several short fields."""
    weights = {n: w for n, w in (weights or EMBEDDING_FIELD_WEIGHTS).items() if n in df.columns}

    def field_part(name: str, weight: float) -> tuple[Column, Column]:
        words = clean_words(F.coalesce(F.col(name), F.lit("")))
        # A word counts once per occurrence, so only the length of the field's vector is needed.
        share = F.try_divide(F.lit(weight), F.sqrt(square_length(words)))
        parts = F.arrays_zip(words.alias("token"), F.array_repeat(share, F.size(words)).alias("part"))
        return parts, F.when(F.size(words) > 0, F.lit(weight)).otherwise(F.lit(0.0))

    fields = [field_part(n, float(w)) for n, w in weights.items()]
    parts = [words for words, _ in fields]
    present = sum((p for _, p in fields), F.lit(0.0))
    rows = df.select(id_col, present.alias("_present"), F.inline(F.concat(*parts)))
    return rows.groupBy(id_col, "token").agg((F.sum("part") / F.max("_present")).alias("weight"))


@dataclass(frozen=True)
class OneHot:
    """Kept categories per field; further ones share a last slot if the field was capped."""

    kept: dict[str, list[str]]
    capped: dict[str, bool]

    @classmethod
    def fit(cls, df: DataFrame, fields: Sequence[str], cap: int = 50) -> OneHot:
        """The ``cap`` most frequent values of every field, counted in one pass over all fields."""
        if not fields:
            return cls({}, {})
        values = F.array(*[F.struct(F.lit(f).alias("f"), F.coalesce(F.col(f), F.lit("")).alias("v")) for f in fields])
        counts = df.select(F.inline(values)).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), F.desc("v")))
        # At most cap + 1 rows per field reach the driver.
        top = counts.withColumn("place", place).filter(F.col("place") <= cap + 1).orderBy("place").collect()
        found = {f: [r["v"] for r in top if r["f"] == f] for f in fields}
        capped = {f: len(v) > cap for f, v in found.items()}
        return cls({f: sorted(v[: cap - 1 if capped[f] else cap]) for f, v in found.items()}, capped)

    def slot(self, field: str, value: Column | None = None) -> Column:
        """Slot number of a value. A value outside the kept ones takes the shared slot or none."""
        names = self.kept[field]
        value = F.coalesce(F.col(field) if value is None else value, F.lit(""))
        other = F.lit(len(names) if self.capped[field] else None).cast("int")
        if not names:
            return other
        lookup = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        return F.coalesce(F.try_element_at(lookup, value), other)

    def width(self, field: str) -> int:
        return len(self.kept[field]) + self.capped[field]

    def vector(self, field: str, value: Column | None = None) -> Column:
        slot = self.slot(field, value)
        return F.transform(F.sequence(F.lit(1), F.lit(self.width(field))), lambda i: F.coalesce((slot == i - 1).cast("double"), F.lit(0.0))) if self.width(field) else F.array().cast("array<double>")


def scaling_shape(df: DataFrame, fields: Sequence[str], method: str, *more: Column) -> dict:
    """(shift, spread) per field and the values of further aggregates, in one pass but for exact quantiles."""
    if method not in ("standard", "minmax", "robust", "log"):
        raise ValueError(f"unknown scaling {method!r}")
    aggs = []
    for f in fields:
        if method == "standard":
            aggs += [F.avg(f), F.stddev_pop(f)]
        elif method == "minmax":
            aggs += [F.min(f), F.max(f) - F.min(f)]
    row = df.agg(*aggs, *more).first() if aggs or more else []
    if method == "log":
        shape = {}
    elif method == "robust":
        quarters = {f: exact_quantiles(df, f, [0.25, 0.5, 0.75]) for f in fields}
        shape = {f: (mid, q3 - q1) for f, (q1, mid, q3) in quarters.items()}
    else:
        shape = {f: (row[2 * i], row[2 * i + 1]) for i, f in enumerate(fields)}
    shape = {f: (float(a or 0), float(b or 0)) for f, (a, b) in shape.items()}
    return {**shape, **(dict(zip(row.__fields__[len(aggs):], row[len(aggs):])) if more else {})}


def scaling(df: DataFrame, fields: Sequence[str], method: str = "standard") -> dict[str, Column]:
    """Scaled column per field. Statistics are one driver row; a spread of 0 leaves the shift only."""
    if method == "log":
        return {f: F.when(F.col(f) > 0, F.log1p(F.col(f))).otherwise(F.col(f)) for f in fields}
    return {f: (F.col(f) - F.lit(a)) / F.lit(b or 1.0) for f, (a, b) in scaling_shape(df, fields, method).items()}


def pca_reduce(df: DataFrame, id_col: str, vec_col: str, components: int = 100, scale: bool = True):
    """Standard-scaled principal components: (id, vec) and the fitted loadings.

    The covariance is summed per partition; only a width x width matrix is central.
    """
    rows = df.select(id_col, doubles(F.col(vec_col)).alias("v"))
    whole = vector_summary(rows, None, "v").first()
    if whole is None or not whole["size"]:
        raise ValueError("no rows to reduce")
    width = len(whole["mean"])
    if scale:
        # A position without spread is only shifted.
        shift = F.array(*[
            F.struct(F.lit(float(m)).alias("m"), F.lit(float(s) or 1.0).alias("s")) for m, s in zip(whole["mean"], whole["std"])
        ])
        rows = rows.withColumn("v", F.zip_with("v", shift, lambda x, t: (x - t["m"]) / t["s"]))
    vectors = rows.select(id_col, array_to_vector("v").alias("v"))
    k = max(1, min(components, width))
    model = PCA(k=k, inputCol="v", outputCol="z").fit(vectors)
    return model.transform(vectors).select(id_col, vector_to_array("z").alias("vec")), model
