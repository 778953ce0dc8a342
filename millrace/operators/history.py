"""Moving an old history into one row per posting, comparing a candidate with what is stored, and keeping the newest days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def migrate(legacy: DataFrame, key: str, at: str, seq: str, values: list[str]) -> DataFrame:
    """One row per key: first and last time, how often, and the values of the latest row. Partial sums serve hot keys."""
    last = F.max_by(F.struct(*values), F.struct(at, seq))
    found = legacy.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen_count"), last.alias("_last"))
    return found.select(key, "first_seen", "last_seen", "seen_count", *(F.col("_last")[v].alias(v) for v in values))


def balance(legacy: DataFrame, migrated: DataFrame, key: str) -> DataFrame:
    """One row of identities that a migration keeps: all rows are counted once, one row per key, rows without a key apart."""
    a = legacy.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("without_key"), F.count_distinct(key).alias("keys"))
    b = migrated.agg(F.count("*").alias("migrated"), F.coalesce(F.sum("seen_count"), F.lit(0)).alias("seen"))
    balanced = (F.col("rows") == F.col("without_key") + F.col("seen")) & (F.col("keys") == F.col("migrated"))
    return a.crossJoin(b).withColumn("balanced", balanced)  # one row each


def compare(stored: DataFrame, candidate: DataFrame, key: str = "id", verdicts_over: float = 0.95, scores_from: float = 0.9) -> DataFrame:
    """How far a candidate's verdicts and scores agree with the stored ones, and whether it may be adopted. Both: key, verdict, score."""
    both = stored.select(key, "verdict", "score").join(candidate.select(key, F.col("verdict").alias("new_verdict"), F.col("score").alias("new_score")), key)
    same, near = F.col("verdict").eqNullSafe(F.col("new_verdict")), F.abs(F.col("score") - F.col("new_score")) <= 1
    found = both.agg(F.count("*").alias("compared"), F.count_if(same).alias("same"), F.count_if(near.isNotNull()).alias("scored"), F.count_if(near).alias("near"))
    found = found.withColumns({"verdict_agreement": F.try_divide("same", "compared"), "score_within_one": F.try_divide("near", "scored")})
    return found.withColumn("adopt", F.coalesce((F.col("verdict_agreement") > verdicts_over) & (F.col("score_within_one") >= scores_from), F.lit(False)))


def newest_days(df: DataFrame, at: str, keep: int) -> DataFrame:
    """Rows of the last ``keep`` days that have rows; the days are found by an aggregate and joined back."""
    days = df.select(F.to_date(at).alias("_day")).distinct().orderBy(F.desc("_day")).limit(keep)
    return df.withColumn("_day", F.to_date(at)).join(F.broadcast(days), "_day", "left_semi").drop("_day")  # ``keep`` rows


def fresh_turns(log: DataFrame, key: str, order: list[str], run_cap: int, fresh_s: float = 30.0) -> DataFrame:
    """Who gives way at each request (key, at, kind): packaging never, all others while it waits; descriptions take ``run_cap`` turns to a search's one.

    A kind waits if it was last asked for within ``fresh_s``.
    """
    w = Window.partitionBy(key).orderBy(*order)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    is_description = F.col("kind") == "description"
    t = F.unix_micros(F.col("at").cast("timestamp"))
    marked = log.withColumns({f"_{k}": F.coalesce(t - F.max(F.when(F.col("kind") == k, t)).over(so_far) <= int(fresh_s * 1e6), F.lit(False)) for k in ("packaging", "search", "description")})
    marked = marked.withColumn("_island", F.coalesce(F.count_if(~is_description).over(before), F.lit(0)))
    island = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("description_run", F.coalesce(F.count_if(is_description).over(island), F.lit(0)))
    gives_way = (
        F.when(F.col("kind") == "packaging", False)
        .when(F.col("_packaging"), True)
        .when(is_description, F.col("_search") & (F.col("description_run") >= run_cap))
        .when(F.col("kind") == "search", F.col("_description") & (F.col("description_run") < run_cap))
        .otherwise(False)
    )
    return marked.withColumn("gives_way", gives_way).drop("_packaging", "_search", "_description", "_island")
