"""Reproducible pseudo-random numbers from keys, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(key: Column) -> Column:
    """0 .. 2**32-1 from the first eight hex digits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash60(key: Column) -> Column:
    """0 .. 2**60-1 from the first fifteen hex digits of the MD5 of a string: for draws among any number of rows."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def keep_fraction(key: Column, fraction: float) -> Column:
    """True for about ``fraction`` of the keys, always the same ones."""
    return hash60(key) < F.lit(int(fraction * 2**60))
