"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small


def bounded(df: DataFrame, by: str, most: int, key: Column) -> DataFrame:
    """About ``most`` rows of each value of ``by``, or all where there are fewer, chosen by a hash of ``key``.

    Column ``weight`` is how many rows of its value a chosen row stands for. Rows without a value are left out.
    """
    shares = small(df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count("*")).alias("_share")))
    place = (F.xxhash64(F.lit("sample"), key) / F.lit(2.0**64)) + F.lit(0.5)
    found = df.join(shares, F.col(by) == F.col("_by"))
    return found.filter((F.col("_share") >= 1) | (place < F.col("_share"))).withColumn("weight", 1 / F.col("_share")).drop("_share", "_by")
