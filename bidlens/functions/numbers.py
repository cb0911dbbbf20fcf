"""Number and price parsing, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bidlens.functions.text import squeeze

STRICT_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
FIRST_NUMBER = r"[-+]?\d*[.,]?\d+"


def squeezed(c: Column) -> Column:
    return F.translate(squeeze(c), ",", ".")


def parse_number(c: Column) -> Column:
    """``1 250 000,00`` -> 1250000.0; else the first number in the text; else 0."""
    return number_of(squeezed(c))


def number_of(s: Column) -> Column:
    """``parse_number`` of a ``squeezed`` text."""
    strict = F.when(s.rlike(STRICT_NUMBER), s.try_cast("double"))
    loose = F.regexp_extract(s, FIRST_NUMBER, 0).try_cast("double")
    return F.coalesce(strict, loose, F.lit(0.0))


def parse_price(c: Column) -> Column:
    """Typed price: exact decimal, null when the text is not a plain number."""
    s = F.translate(c, ", ", ".")
    return F.when(s.rlike(STRICT_NUMBER), s.try_cast("decimal(15,2)"))


def positive_price(c: Column) -> Column:
    """Price out of free text in either decimal convention; null unless above 0.

    The sign is dropped with all other characters that are no digit, dot or comma.
    """
    value = plain_price(price_signs(c))
    return F.when(value > 0, value)


def price_signs(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.,]", "")


def plain_price(s: Column) -> Column:
    """Number of a text of ``price_signs``."""
    # The last separator is the decimal one if it is a comma; commas before a last dot only group.
    plain = F.when(s.rlike(r",[^.]*$"), F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", ""))
    return F.when(plain.rlike(STRICT_NUMBER), plain.try_cast("double"))


def extract_price(*fields: Column) -> Column:
    """First field that holds a positive price."""
    return F.coalesce(*[positive_price(f) for f in fields])


def scale_minmax(c: Column, low: Column, high: Column) -> Column:
    return F.when(high - low == 0, F.lit(0.0)).otherwise(F.try_divide(c - low, high - low))


def scale_zscore(c: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise(F.try_divide(c - mean, std))


def scale_log(c: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), c))
