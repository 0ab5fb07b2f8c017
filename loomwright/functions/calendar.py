"""Calendar fields, names and periodic values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monday is weekday 0.
FIELDS = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "weekday": F.weekday,
    "dayofweek": F.weekday,
    "day_of_week": F.weekday,
    "dayofyear": F.dayofyear,
    "day_of_year": F.dayofyear,
}
NAME_FORMATS = {"month": "MMMM", "day": "EEEE"}


def field(season: str, moment: Column) -> Column:
    if season not in FIELDS:
        raise KeyError(f"unknown calendar field {season}; known: {sorted(FIELDS)}")
    return FIELDS[season](moment)


def name(season: str, moment: Column) -> Column:
    return F.date_format(moment, NAME_FORMATS[season])


def weekday_name(moment: Column) -> Column:
    return name("day", moment)


def wave(value: Column, peak: float) -> Column:
    return F.sin(value * F.lit(2 * math.pi) / F.lit(float(peak)))


def truncated(moment: Column, unit: str) -> Column:
    """Start of the unit; ``date`` and ``day`` give a date-grained timestamp."""
    unit = "day" if unit == "date" else unit
    return F.date_trunc(unit, moment).cast("timestamp_ntz")


def cosine_factors(n: int, peak_at: float | None = None) -> Sequence[float]:
    """One cosine period over ``n`` slots, highest at ``peak_at`` (the middle slot when not given)."""
    middle = n // 2 if peak_at is None else peak_at
    return [(1.0 + math.cos(2.0 * math.pi * (slot - middle) / n)) / n for slot in range(n)]
