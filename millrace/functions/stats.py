"""Bounds, shares and rates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_upper(hits: Column, trials: Column, z: float = 1.96) -> Column:
    """Upper end of the Wilson interval; 1 without trials."""
    n = trials.cast("double")
    p = hits / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(trials == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (centre + spread) / (1 + z * z / n)))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, null when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def run_cap(p: Column) -> Column:
    """How many turns in a row a share ``p`` of the turns stands for, at least 1; halves round to even."""
    return F.greatest(F.lit(1), F.bround(p / (1 - p)).cast("int"))


def speeds(spacings: Column) -> Column:
    """How many times faster than the first each spacing is."""
    return F.transform(spacings, lambda x: F.element_at(spacings, 1) / x)


def hold_level(spacings: Column, most: float = 3.0) -> Column:
    """The highest level (from 1) at most ``most`` times as fast as the first."""
    return F.array_max(F.transform(F.sequence(F.lit(1), F.size(spacings)), lambda k: F.when(F.element_at(spacings, 1) / F.element_at(spacings, k.cast("int")) <= most, k)))
