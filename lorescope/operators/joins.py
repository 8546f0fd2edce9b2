"""Joins in which NULL keys meet each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right`` where all keys are equal, or NULL on both sides.

    With ``left_anti`` or ``left_semi``, the rows of ``left`` without or with such keys.
    """
    renamed = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_right")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_{k}_right" for k in keys])
