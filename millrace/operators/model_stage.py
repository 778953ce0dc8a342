"""Model stages as data: batches go to an injected provider, answers come back by place, and calls leave rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import running

Provider = Callable[[DataFrame], DataFrame]


def error_kind(error: Column, message: Column, quota: str = "quota|per day|daily limit") -> Column:
    """What a failed call counts as, from its error's name and message; null (no error) is ok."""
    return (
        F.when(error.isNull(), "ok")
        .when(F.coalesce(message, F.lit("")).rlike(f"(?i){quota}"), "quota_exhausted")
        .when(error == "RateLimitError", "rate_limited")
        .when(error == "APITimeoutError", "timeout")
        .when(error.isin("InvalidLLMOutput", "ValidationError", "JSONDecodeError"), "invalid_output")
        .otherwise("error")
    )


def with_failover(rows: DataFrame, keys: list[str], providers: dict[str, Provider], most: dict[str, Column | int] | None = None, order: list[str] | None = None, per: list[str] | None = None) -> DataFrame:
    """Answers of the first provider that has one for a row; the next gets only the rows still without. Adds ``provider``.

    A provider takes rows and returns keys and its columns; all providers return the same columns. Rows that
    no provider answers are left out, so that they stay due. A provider named in ``most`` is asked for that many rows of
    each ``per`` (a day) at most, what its share of a budget has left, the first by ``order`` (which leaves no ties); the others go on to the
    next provider. Places are counted over ranges of the order, not in one task for each ``per``.
    """
    out, left, most = None, rows, most or {}
    for name, ask in providers.items():
        due = left
        if name in most:
            groups = per or []
            placed = running(left if groups else left.withColumn("_all", F.lit(0)), groups or ["_all"], order or keys, {"_place": F.lit(1)})
            due = placed.filter(F.col("_place") <= most[name]).select(*rows.columns)
        answers = ask(due).withColumn("provider", F.lit(name))
        out = answers if out is None else out.unionByName(answers)
        left = left.join(answers.select(*keys), keys, "left_anti")
    return rows.join(out, keys)


def stage_state(rows: DataFrame, answered: DataFrame, keys: list[str], batch: list[str], per: list[str], most_failed: float = 0.2) -> DataFrame:
    """Per run (``per``): batches, those of which no row was answered, and whether these are at least ``most_failed`` of all, so that the run counts as degraded."""
    told = rows.join(answered.select(*keys, F.lit(True).alias("_told")), keys, "left")
    each = told.groupBy(*per, *batch).agg(F.count("_told").alias("_n"))
    found = each.groupBy(*per).agg(F.count("*").alias("batches"), F.count_if(F.col("_n") == 0).alias("failed_batches"))
    return found.withColumn("degraded", F.col("failed_batches") / F.col("batches") >= most_failed)


def call_rows(answered: DataFrame, batch_keys: list[str], stage: str, tokens: Column) -> DataFrame:
    """One accounting row per batch and provider: rows and tokens."""
    return answered.groupBy(*batch_keys, "provider").agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens")).withColumn("stage", F.lit(stage))


def keyword_score(text: str, words: dict[str, int], most: int = 10) -> Column:
    """A deterministic stand-in for a scorer: 1 plus the points of the words that a text has, at most ``most``."""
    points = sum((F.when(F.lower(F.col(text)).rlike(rf"\b{w}\b"), p).otherwise(0) for w, p in words.items()), F.lit(1))
    return F.least(points, F.lit(most))
