"""Daily metrics, comparisons and warnings derived from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import share


def before_after(days: DataFrame, split: date | str, metrics: list[str], least_days: int = 5) -> DataFrame:
    """Per metric: days and averages before and from ``split``, the change in percent, and whether too few days stand behind it."""
    early = F.col("day") < F.lit(str(split)).cast("date")
    long = days.select("day", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("v")) for m in metrics))).alias("m")).select("day", "m.*")
    found = long.groupBy("metric").agg(F.count_if(early).alias("days_before"), F.count_if(~early).alias("days_after"), F.sum(F.when(early, F.col("v"))).alias("a"), F.sum(F.when(~early, F.col("v"))).alias("b"))
    found = found.withColumns({"before_avg": share(F.col("a"), F.col("days_before")), "after_avg": share(F.col("b"), F.col("days_after"))})
    change = F.try_divide((F.col("after_avg") - F.col("before_avg")) * 100, F.col("before_avg"))
    return found.select("metric", "days_before", "days_after", F.round("before_avg", 6).alias("before_avg"), F.round("after_avg", 6).alias("after_avg"), F.round(change, 6).alias("change_pct"), (F.least("days_before", "days_after") < least_days).alias("indicative_only"))


def warnings(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """keys and warning: one row for each rule that holds; an unknown condition doesn't."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for text, c in rules)), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("warning"))


def daily_metrics(runs: DataFrame, offers: DataFrame, packages: DataFrame) -> DataFrame:
    """Per day with a run, an offer or a package: run metrics null where no run was, offer and package counts 0.

    runs: day, commit, tokens, rate_limits, deferred; offers: day, strong; packages: day.
    """
    r = runs.groupBy("day").agg(F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("commit")), ",").alias("commits"), F.when(F.count("rate_limits") + F.count("deferred") > 0, F.coalesce(F.sum("rate_limits"), F.lit(0)) + F.coalesce(F.sum("deferred"), F.lit(0))).alias("limits"))
    o = offers.groupBy("day").agg(F.count("*").alias("scored"), F.count_if("strong").alias("high"))
    p = packages.groupBy("day").agg(F.count("*").alias("packaged"))
    found = r.join(o, "day", "fullouter").join(p, "day", "fullouter")
    return found.select("day", "runs", "tokens", "commits", "limits", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("scored", "high", "packaged")))


def as_text(days: DataFrame, metrics: list[str]) -> DataFrame:
    """day and line: ``2024-01-05  requests 12 (+3), refused ? (?)``, each metric with its change since the day before in the table; unknown is ``?``.

    The days of a report are few, and put in order by one window.
    """
    w = Window.orderBy("day")
    number = lambda c, plus: F.when(c.isNull(), "?").otherwise(F.concat(F.when(F.lit(plus) & (c >= 0), "+").otherwise(""), F.round(c.cast("double"), 2).cast("decimal(20,2)").cast("string")))
    part = lambda m: F.concat(F.lit(f"{m} "), number(F.col(m), False), F.lit(" ("), number(F.col(m) - F.lag(m).over(w), True), F.lit(")"))
    return days.select("day", F.concat(F.col("day").cast("string"), F.lit("  "), F.concat_ws(", ", *map(part, metrics))).alias("line"))


def comparison_text(compared: DataFrame) -> DataFrame:
    """metric and line of what :func:`before_after` gives: ``requests: 10.00 before, 12.50 after (+25.0 %)``, marked where too few days stand behind it."""
    two = lambda c: F.coalesce(F.col(c).cast("decimal(20,2)").cast("string"), F.lit("?"))
    change = F.when(F.col("change_pct").isNull(), "?").otherwise(F.concat(F.when(F.col("change_pct") >= 0, "+").otherwise(""), F.col("change_pct").cast("decimal(20,1)").cast("string")))
    note = F.when(F.col("indicative_only"), F.concat(F.lit(", indicative only: "), F.col("days_before").cast("string"), F.lit(" and "), F.col("days_after").cast("string"), F.lit(" days"))).otherwise("")
    return compared.select("metric", F.concat("metric", F.lit(": "), two("before_avg"), F.lit(" before, "), two("after_avg"), F.lit(" after ("), change, F.lit(" %)"), note).alias("line"))
