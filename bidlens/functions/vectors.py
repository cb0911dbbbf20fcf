"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))


def unit(a: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: F.try_divide(x, n)))


def scaled(a: Column, factor: float | Column) -> Column:
    f = F.lit(factor) if isinstance(factor, float) else factor
    return F.transform(a, lambda x: x * f)


def fit_dimension(a: Column, size: int) -> Column:
    """Cut or zero-pad to a given width; only on request, never silently."""
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0)))
    return F.slice(F.concat(a, pad), 1, size)


def distance_to_similarity(d: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))
    return F.greatest(F.lit(0.0), F.lit(1.0) - d)


def fuse(blocks: dict[str, Column], method: str = "concatenate") -> Column:
    """One vector out of the four feature blocks."""
    # Block weights of the weighted fusion.
    weights = {"text": 0.4, "categorical": 0.2, "numerical": 0.2, "temporal": 0.2}
    parts = [scaled(v, weights[name]) if method == "weighted" else v for name, v in blocks.items()]
    return F.concat(*parts)
