"""Small helpers for the catalog: output rounding and text forms of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(*names: str, digits: int = 6) -> list[Column]:
    """Rounded output columns (float sums are order dependent in the last bits)."""
    return [F.round(n, digits).alias(n) for n in names]


def sql_rnd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def day_text(c: str, alias: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(alias or c)


def time_text(c: str, alias: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(alias or c)


def sql_day(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {alias or c}"


def sql_time(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c}"
