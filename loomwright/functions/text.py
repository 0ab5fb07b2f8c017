"""String and string-list columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that mean the same kind, applied in this order.
DEVICE_PATTERNS = (
    ("phone|mediaplayer|mobile phones|mobiles", "mobile"),
    ("pc|desktops|laptops", "desktop"),
)
DEVICE_KINDS = ("desktop", "tablet", "mobile")

# Browser names in order of priority, and what is cut off before.
BROWSERS = (
    "Internet Explorer", "Edge", "Firefox", "Chrome", "Safari", "Opera", "iPhone", "Android", "Samsung",
)
BROWSER_CUTS = (r" \d+$", r" (\.+)$")

# Fixed value: names of re-encoded videos.
ENCODED_VIDEO = r"^.+[0-9]+_[0-9]+_[0-9]+k\..+$"


def cut_all(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, F.lit(p), F.lit("")), patterns, text)


def device_types(names: Column) -> Column:
    """Device names as desktop, tablet or mobile; names of no such kind are dropped."""

    def kind(name: Column) -> Column:
        for pattern, replacement in DEVICE_PATTERNS:
            name = F.regexp_replace(name, F.lit(pattern), F.lit(replacement))
        return name

    named = F.transform(names, kind)
    return F.filter(named, lambda n: n.rlike("|".join(DEVICE_KINDS)))


def canonical_names(names: Column, cuts: Sequence[str], known: Sequence[str]) -> Column:
    """Each element as the first known name it contains; elements with none are dropped."""

    def first_known(name: Column) -> Column:
        short = cut_all(name, cuts)
        return F.coalesce(*[F.when(F.contains(short, F.lit(k)), F.lit(k)) for k in known])

    return F.array_compact(F.transform(names, first_known))


def playable_videos(files: Column) -> Column:
    return F.filter(files, lambda f: ~F.coalesce(f.rlike(ENCODED_VIDEO), F.lit(False)))


def is_integer(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def joined(texts: Sequence[Column], separator: str = ". ") -> Column:
    return F.concat_ws(separator, *texts)
