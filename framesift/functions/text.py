"""Small text expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_space(c: Column) -> Column:
    """Trim every kind of white space on both ends (Spark's ``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def strip_sequence_prefix(c: Column) -> Column:
    """Drop a leading ``[...]`` group unless it is the whole line."""
    return F.when(c.startswith("["), F.regexp_replace(c, r"(?sU)^\[[^\]]*\](?=.)\s*", "")).otherwise(c)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def as_long(c: Column) -> Column:
    """Integer value of a captured text, NULL where it is none or too large."""
    return c.try_cast("bigint")


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)
