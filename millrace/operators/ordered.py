"""Running sums, trailing windows and shifted values over a key's order, where a key may have more rows than a task holds.

Rows are cut into runs of neighbours by ranges of (key, order), so a key with most of the rows fills many runs. A run
sums its own values; the sums of the runs before it, a few numbers for each run, are added to them. Windows of the
last n rows go by blocks of places, each with the last rows of the block before; windows of time are running sums
of what comes in and what has left by then.

``order`` must leave no ties between rows whose results differ. A null key is a key; rows with a null in ``order`` come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.keys import joined
from millrace.sources.store import shared_table

#: Rows of a block, whose windows one task computes.
BLOCK = 100_000


def _columns(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def running(df: DataFrame, keys: str | list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the running sum of each of ``sums`` (nulls count as 0) up to and including each row of its key."""
    keys = _columns(keys)
    valued = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    held = shared_table(valued.repartitionByRange(*keys, *order).withColumn("_run", F.spark_partition_id()), df.sparkSession)
    per_run = held.groupBy(*keys, "_run").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run of a key
    offsets = per_run.select(*keys, "_run", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    own = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = held.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(own) for n in sums})
    added = joined(inside, offsets, [*keys, "_run"]).withColumns({n: F.col(f"_v_{n}") + F.col(f"_o_{n}") for n in sums})
    return added.drop("_run", *(f"_{k}_{n}" for k in "vo" for n in sums))


def trailing(df: DataFrame, keys: str | list[str], order: list[str], n: int, columns: Callable[[WindowSpec], dict[str, Column]], within: str | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with ``columns(window)``, for a window whose rows reach back by ``n`` at most; it may be cut further by a column ``within`` that changes along the order."""
    keys, block = _columns(keys), max(block, n)
    numbered = running(df, keys, order, {"_place": F.lit(1)}).withColumn("_home", F.floor((F.col("_place") - 1) / block))
    late = F.pmod(F.col("_place") - 1, F.lit(block)) >= block - n
    spread = numbered.withColumn("_block", F.explode(F.when(late, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    window = Window.partitionBy(*keys, "_block", *([within] if within else [])).orderBy("_place")
    return spread.withColumns(columns(window)).filter("_block = _home").drop("_block", "_home", "_place")


def shifted(df: DataFrame, keys: str | list[str], order: list[str], columns: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with each of ``columns`` as it was in the row before of the same key, null in a key's first."""
    return trailing(df, keys, order, 1, lambda w: {n: F.lag(c).over(w) for n, c in columns.items()}, block=block)


def rolling(df: DataFrame, keys: str | list[str], at: Column, width: int, sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the key's rows whose ``at`` (whole numbers) lies in [own - ``width``, own]; null where ``at`` is.

    A moment's sum comes in at its time and leaves after its time plus ``width``; rows of one moment are summed up first.
    """
    keys = _columns(keys)
    timed = df.withColumn("_moment", at)
    moments = timed.filter("_moment IS NOT NULL").groupBy(*keys, "_moment").agg(*(F.sum(c).alias(f"_in_{n}") for n, c in sums.items()))
    none = {f"_{k}_{n}": F.lit(0) for k in ("in", "out") for n in sums}
    comes = moments.withColumns({**{c: v for c, v in none.items() if c.startswith("_out")}, "_came": F.lit(1)})
    leaves = moments.select(*keys, (F.col("_moment") + width).alias("_moment"), *(F.col(f"_in_{n}").alias(f"_out_{n}") for n in sums)).withColumns({**{c: v for c, v in none.items() if c.startswith("_in")}, "_came": F.lit(0)})
    events = comes.unionByName(leaves).groupBy(*keys, "_moment").agg(F.max("_came").alias("_came"), *(F.sum(c).alias(c) for c in none))
    summed = running(events, keys, ["_moment"], {**{f"_all_{n}": F.col(f"_in_{n}") for n in sums}, **{f"_gone_{n}": F.col(f"_out_{n}") for n in sums}})
    # what leaves at a moment is still there at it
    found = summed.filter("_came = 1").select(*keys, "_moment", *((F.col(f"_all_{n}") - F.col(f"_gone_{n}") + F.col(f"_out_{n}")).alias(n) for n in sums))
    return joined(timed, found, [*keys, "_moment"], "left").drop("_moment")


def ranked(values: DataFrame, keys: str | list[str], value: str, count: str = "n") -> DataFrame:
    """``values`` (keys, value, count of its rows; one row for each value) with ``first`` and ``last``, the places (from 0) that these rows take in their key's order."""
    summed = running(values, keys, [value], {"last": F.col(count)})
    return summed.withColumns({"first": F.col("last") - F.col(count), "last": F.col("last") - 1})
