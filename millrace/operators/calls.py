"""Reports over a log of model calls: stage, model, provider, outcome, latency, tokens, at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import share
from millrace.operators.keys import joined
from millrace.operators.ordered import ranked, rolling, running, shifted
from millrace.sources.store import shared_table


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Continuous percentiles by key, exactly, with no task that holds a key's values.

    Distinct values are counted and given the places that they take in their key's order (:func:`~millrace.operators.ordered.ranked`);
    a wanted rank lies between the two values at the places beside it. Nulls don't count.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("n"))
    placed = shared_table(ranked(counted, keys, "_value"), df.sparkSession)
    sizes = placed.groupBy(*keys).agg((F.max("last") + 1).alias("_all"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_all") - 1)).alias("rank")) for name, p in shares.items()))
    found = joined(placed, sizes, keys).withColumn("w", F.explode(F.filter(wanted, lambda w: (F.ceil(w["rank"]) >= F.col("first")) & (F.floor(w["rank"]) <= F.col("last")))))
    at = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("_value")))
    both = found.groupBy(*keys, F.col("w.name").alias("name")).agg(at(F.floor("w.rank")).alias("a"), at(F.ceil("w.rank")).alias("b"), F.max(F.col("w.rank") - F.floor("w.rank")).alias("f"))
    each = both.withColumn("v", F.col("a") + F.col("f") * (F.col("b") - F.col("a")))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))


def latency_report(calls: DataFrame, keys: list[str], outcomes: list[str], latency: str = "latency") -> DataFrame:
    """Continuous p50 and p95 of the latency and one count per outcome."""
    counts = calls.groupBy(*keys).agg(F.count("*").alias("calls"), *(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in outcomes))
    found = percentiles(calls, keys, latency, {"p50": 0.5, "p95": 0.95})
    return joined(counts, found, keys, "left").select(*keys, "calls", "p50", "p95", *(f"n_{o}" for o in outcomes))


def attempts(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The values of each run's last attempt, and how many attempts there were. runs: keys, attempt."""
    last = F.max_by(F.struct(*values), "attempt").alias("_last")
    return runs.groupBy(*keys).agg(F.max("attempt").alias("attempts"), last).select(*keys, "attempts", *(F.col("_last")[v].alias(v) for v in values))


def verdict_mix(calls: DataFrame, provider: str, counts: list[str]) -> DataFrame:
    """Sums of verdict counts by provider; calls without one fall together."""
    return calls.groupBy(F.coalesce(provider, F.lit("none")).alias(provider)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))


def answers_by_model(calls: DataFrame, key: str) -> DataFrame:
    """Per stage: calls, calls without an answer, and the answers by model, the most frequent first, as ``model:n``."""
    counts = calls.groupBy(key, "model").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct((-F.col("n")).alias("o"), "model"))))  # a row per model
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["model"], (-x["o"]).cast("string"))), " ")
    return counts.groupBy(key).agg(F.sum("n").alias("calls"), F.coalesce(F.sum(F.when(F.col("model").isNull(), F.col("n"))), F.lit(0)).alias("unanswered"), text.alias("answers"))


def stage_rows(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and tokens by stage and answering model; calls without an answer fall together whatever was asked for."""
    first = calls.groupBy(*keys, "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return first.groupBy(*keys, F.coalesce("model", F.lit("no response")).alias("model")).agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))


def fallback_share(calls: DataFrame, key: str, primary: Column, least: int = 5, most: float = 0.2) -> DataFrame:
    """Per stage: calls, unanswered ones, the share answered by another model than the primary, and whether that warns."""
    found = calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(F.col("model").isNull()).alias("unanswered"), F.count_if(F.col("model").isNotNull() & (F.col("model") != primary)).alias("other"))
    answered = F.col("calls") - F.col("unanswered")
    return found.withColumn("fallback_share", share(F.col("other"), answered)).withColumn("warns", (answered >= least) & F.coalesce(F.col("fallback_share") > most, F.lit(False)))


def limit_use(calls: DataFrame, keys: list[str], limit: float, tokens: str = "tokens", order: list[str] | None = None, at: str = "at") -> DataFrame:
    """Per key (a provider's UTC day): requests, tokens, share of the limit, and requests before it was reached.

    Tokens aren't negative. Hours are summed first, and only the hour in which the limit is reached is put in order.
    """
    order = order or [at]
    hour = F.date_trunc("hour", F.col(at).cast("timestamp"))
    hours = calls.withColumn("_hour", hour).groupBy(*keys, "_hour").agg(F.count("*").alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).alias("s"))
    ends = F.sum("s").over(Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0))  # a key's hours
    placed = hours.withColumn("end", ends)
    crossed = placed.filter((F.col("end") > limit) & (F.col("end") - F.col("s") <= limit)).select(*keys, "_hour", (F.col("end") - F.col("s")).alias("_start"))
    used = F.col("_start") + F.sum(F.coalesce(tokens, F.lit(0))).over(Window.partitionBy(*keys, "_hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = joined(calls.withColumn("_hour", hour), crossed, [*keys, "_hour"]).withColumn("used", used).groupBy(*keys).agg(F.count_if(F.col("used") <= limit).alias("_part"))
    found = placed.groupBy(*keys).agg(F.sum("n").alias("requests"), F.sum("s").alias("tokens"), F.coalesce(F.sum(F.when(F.col("end") <= limit, F.col("n"))), F.lit(0)).alias("_whole"))
    found = joined(found, last, keys, "left").withColumn("within", F.col("_whole") + F.coalesce("_part", F.lit(0))).drop("_whole", "_part")
    return found.withColumn("limit_share", F.col("tokens") / F.lit(float(limit)))


def may_call(use: DataFrame, stop_line: int, share: float | None = None, requests: str = "requests", stage_requests: str = "stage_requests") -> DataFrame:
    """Whether a stage may call today: all requests under the stop line, and the stage's own under its share of it."""
    own = F.lit(True) if share is None else F.col(stage_requests) < F.floor(F.lit(stop_line) * F.lit(share))
    return use.withColumn("may_call", (F.col(requests) < stop_line) & own)


def running_gates(calls: DataFrame, keys: list[str], order: list[str], stop_line: int, token_line: int, window_s: int, window_tokens: int, stage: str, share: float, at: str = "at", tokens: str = "tokens") -> DataFrame:
    """What a provider's budget stood at before each call of a key (a provider's day), and whether the gates let it pass.

    ``requests_before`` and ``tokens_before`` of the key, ``stage_before`` of ``stage`` alone, and ``window_before``, the tokens of the key's other
    calls in the ``window_s`` seconds up to it. A call passes under the stop line, the token line and the window's tokens (its own
    included), and one of ``stage`` under its share of the stop line too. A day's calls aren't put in order in one task.
    """
    own = F.coalesce(F.col(tokens), F.lit(0))
    is_stage = F.coalesce(F.col("stage") == stage, F.lit(False))
    summed = running(calls, keys, order, {"_n": F.lit(1), "_s": is_stage.cast("int"), "_t": own})
    found = rolling(summed, keys, F.unix_micros(F.col(at).cast("timestamp")), window_s * 1_000_000, {"_w": own})
    found = found.withColumns({"requests_before": F.col("_n") - 1, "stage_before": F.col("_s") - is_stage.cast("int"), "tokens_before": F.col("_t") - own, "window_before": F.col("_w") - own}).drop("_n", "_s", "_t", "_w")
    of_stage = F.when(is_stage, F.col("stage_before") < int(stop_line * share)).otherwise(F.lit(True))
    return found.withColumn("may_call", (F.col("requests_before") < stop_line) & (F.col("tokens_before") < token_line) & (F.col("window_before") + own <= window_tokens) & of_stage)


def degraded_runs(calls: DataFrame, run: list[str], batch: list[str], usable: Column, most: float = 0.2) -> DataFrame:
    """Per run: its batches, those without a usable answer, and whether these are at least the share ``most`` of all."""
    each = calls.groupBy(*run, *batch).agg(F.count_if(usable).alias("_ok"))
    found = each.groupBy(*run).agg(F.count("*").alias("batches"), F.count_if(F.col("_ok") == 0).alias("failed_batches"))
    return found.withColumn("degraded", F.col("failed_batches") / F.col("batches") >= most)


def additive_upsert(state: DataFrame, news: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Totals by key of what was there and what came; one shuffle on the key."""
    return state.select(*keys, *values).unionByName(news.select(*keys, *values)).groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def silent(calls: DataFrame, key: str, now: Column, usable: Column, hours: int = 6, back: int = 12) -> DataFrame:
    """Stages that are called but don't answer.

    Of the calls of the last ``back`` hours, those after a key's last usable answer (all, if there is none): a
    key is silent if the first of them is at least ``hours`` old and the last younger.
    """
    within = lambda h: now - F.make_dt_interval(hours=F.lit(h))
    recent = calls.filter((F.col("at") > within(back)) & (F.col("at") <= now))
    last = recent.groupBy(key).agg(F.max(F.when(usable, F.col("at"))).alias("answered"))
    after = recent.join(last, key).filter(F.col("answered").isNull() | (F.col("at") > F.col("answered")))
    return after.groupBy(key).agg(F.min("at").alias("since"), F.max("at").alias("last_call"), F.count("*").alias("calls")).filter((F.col("since") <= within(hours)) & (F.col("last_call") > within(hours)))


def agreement(df: DataFrame, rules: dict[str, tuple[Column, Column]], least: int = 100, rate: float = 0.95) -> DataFrame:
    """Per rule (its verdict and the accepted one): decided, agreed, undecided, rate, and whether it is ready for use."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), (a.isNotNull() & b.isNotNull()).alias("decided"), F.coalesce(a == b, F.lit(False)).alias("agreed")) for name, (a, b) in rules.items())))
    found = df.select(each.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(F.count_if("r.decided").alias("decided"), F.count_if("r.agreed").alias("agreed"), F.count_if(~F.col("r.decided")).alias("undecided"))
    found = found.withColumn("rate", share(F.col("agreed"), F.col("decided")))
    return found.withColumn("ready", (F.col("decided") >= least) & F.coalesce(F.col("rate") > rate, F.lit(False)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must leave no ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_by(df: DataFrame, keys: list[str], version: list[str], values: list[str]) -> DataFrame:
    """The values of the largest version of each key: an aggregate with partial sums, for hot keys."""
    top = F.max(F.struct(*version, *values)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col("_top")[c].alias(c) for c in [*version, *values]))


def suppressed(issues: DataFrame, key: str, repeat_us: int) -> DataFrame:
    """Whether each report of an issue repeats the one before within ``repeat_us`` (the stateless form)."""
    timed = issues.withColumn("_t", F.unix_micros(F.col("at").cast("timestamp")))
    found = shifted(timed, key, ["_t"], {"_before": F.col("_t")})
    return found.withColumn("is_suppressed", F.coalesce(F.col("_t") - F.col("_before") < repeat_us, F.lit(False))).drop("_t", "_before")
