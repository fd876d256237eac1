"""Timestamp canonicalisation and data-age classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.settings import SETTINGS


def parse_timestamp(value) -> Column:
    """ISO text (offset or none = UTC), date text, or epoch seconds / milliseconds.

    Anything else is NULL. Epoch numbers above 1e12 are milliseconds.
    """
    s = F.trim(F.col(value) if isinstance(value, str) else value)
    number = F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))
    seconds = F.when(number > 1e12, number / 1000.0).otherwise(number)
    epoch = F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))
    iso = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?$"),
                 s.try_cast("timestamp"))
    return F.coalesce(iso, epoch)


def age_seconds(ts, as_of) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 1_000_000.0


def freshness_class(age: Column) -> Column:
    """Data-age class, from real_time up to annual."""
    out = F.lit("annual")
    for name, limit in reversed(SETTINGS.freshness_seconds):
        out = F.when(age <= limit, name).otherwise(out)
    return F.when(age.isNull(), None).otherwise(out)


def fresh_enough(age: Column, expected: Column) -> Column:
    """Does the age meet the limit of the expected class (unknown class: daily)?"""
    limits = dict(SETTINGS.freshness_seconds) | {"annual": 86400 * 365}
    limit = F.lit(limits["daily"])
    for name, seconds in limits.items():
        limit = F.when(expected == name, seconds).otherwise(limit)
    return age <= limit
