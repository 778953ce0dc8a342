"""Joins on keys that may be null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` and the other columns of ``right`` where their keys are equal, null and null too."""
    other = right.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(other, same, how).drop(*(f"_key_{k}" for k in keys))
