"""Day-first date parsing and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from bidlens.functions.text import SPACE, strip

WITH_TIME = r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}$"
DAY_ONLY = r"^\d{1,2}\.\d{1,2}\.\d{4}$"
FEATURES = ["timestamp", "day_of_week", "month", "quarter", "year", "days_from_reference"]


def single_spaced(c: Column) -> Column:
    """Runs of white space between date and time count as one."""
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def _stamp(c: Column, day_only: bool = False, single: Column | None = None) -> Column:
    """Timestamp of a text in exactly one of the two forms, null for days that do not exist.

    ``single`` is the text ``single_spaced``, where it is at hand.
    """
    day = F.when(c.rlike(DAY_ONLY), F.try_to_timestamp(c, F.lit("d.M.yyyy")))
    if day_only:
        return day
    single = single_spaced(c) if single is None else single
    return F.coalesce(F.when(single.rlike(WITH_TIME), F.try_to_timestamp(single, F.lit("d.M.yyyy H:m"))), day)


def parse_date(c: Column) -> Column:
    """``15.03.2024 10:30`` or ``15.03.2024``, then once more without foreign characters."""
    return date_of(strip(c))


def date_of(text: Column) -> Column:
    """``parse_date`` of a text without white space at its ends."""
    return F.coalesce(_stamp(text), bare_date(text))


def plain_date(text: Column, single: Column) -> Column:
    """First part of ``date_of``: the text as it is, and ``single_spaced``."""
    return _stamp(text, single=single)


def bare_date(text: Column) -> Column:
    """Second part: without foreign characters."""
    bare = F.regexp_replace(text, rf"[^\d.:{SPACE}]", "")
    return F.when(bare != text, _stamp(bare))


def parse_datetime(c: Column) -> Column:
    """Strict form for the typed table: no clean-up first."""
    return _stamp(c)


def parse_day(c: Column) -> Column:
    """Date part of the first word."""
    first = F.when(F.contains(c, F.lit(" ")), F.get(F.split(strip(c), f"[{SPACE}]+"), F.lit(0))).otherwise(c)
    return F.to_date(_stamp(first, day_only=True))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def date_features(ts: Column, reference: Column | None = None) -> Column:
    """Struct of six doubles, all 0 when the date is missing."""
    days = F.lit(0.0) if reference is None else F.coalesce((seconds(ts) - seconds(reference)) / 86400.0, F.lit(0.0))
    parts = [
        seconds(ts), F.weekday(ts), F.month(ts), F.quarter(ts), F.year(ts), days,
    ]
    return F.struct(
        *[
            F.when(ts.isNull(), F.lit(0.0)).otherwise(p.cast("double")).alias(name)
            for p, name in zip(parts, FEATURES)
        ]
    )


def temporal_vector(features: Column, method: str = "cyclical") -> Column:
    """Feature struct -> vector in one of three encodings."""
    def field(name: str) -> Column:
        return features.getField(name)

    if method == "unix":
        return F.array(field("timestamp"))
    if method == "components":
        return F.array(*[field(n) for n in FEATURES])
    if method != "cyclical":
        raise ValueError(f"unknown temporal encoding {method!r}")
    week = field("day_of_week") * (2 * math.pi / 7)
    year = (field("month") - 1) * (2 * math.pi / 12)
    return F.array(
        field("timestamp"), field("days_from_reference"),
        F.sin(week), F.cos(week), F.sin(year), F.cos(year),
        field("quarter"), field("year"),
    )
