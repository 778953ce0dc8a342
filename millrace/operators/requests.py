"""Accounting over a request log: at, source, status, outcome."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.functions.timeutil import day_spine, local_day, micros
from millrace.operators.ordered import BLOCK, rolling, running, shifted, trailing

# Statuses by which a source refuses.
REFUSALS = (403, 429)


def outcome_of(status: Column, refusals: tuple[int, ...] = REFUSALS) -> Column:
    return F.when(status.isin(*refusals), "refused").when(status == 200, "ok").otherwise("error")


def status_kind(status: Column) -> Column:
    """What a status means for a walk: clean, end (nothing there), throttled, transient (asked again), or failed; null (no response) is transient."""
    # Statuses of job boards.
    return F.when(status == 200, "clean").when(status == 400, "end").when(status.isin(429, 999), "throttled").when(status.isNull() | status.isin(500, 502, 503, 504), "transient").otherwise("failed")


def refused(outcome: Column, status: Column, by_source: dict[str, tuple[int, ...]] | None = None, source: Column | None = None) -> Column:
    """Refused by its outcome, or by a status that its source (or any) refuses with."""
    out = status.isin(*REFUSALS)
    for name, codes in (by_source or {}).items():
        out = F.when(source == name, status.isin(*codes)).otherwise(out)
    return F.coalesce(outcome == "refused", F.lit(False)) | F.coalesce(out, F.lit(False))


def code_of(outcome: Column, status: Column) -> Column:
    return F.when(status.isNotNull(), status.cast("string")).when(outcome == "ok", "nocode").otherwise("none")


def codes_text(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, codes: ``200:3 429:1 nocode:2 none:1``; numbers ascending, then the two names."""
    counts = df.groupBy(*keys, code_of(F.col("outcome"), F.col("status")).alias("code")).agg(F.count("*").alias("n"))
    place = F.coalesce(F.col("code").try_cast("int"), F.when(F.col("code") == "nocode", 1_000_000).otherwise(1_000_001))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.concat_ws(":", "code", F.col("n").cast("string")).alias("text"))))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("codes"))


def daily_requests(log: DataFrame, first: date | str, last: date | str, zone: str, sources: DataFrame) -> DataFrame:
    """Per source and local day, also silent ones: sent, ok, refused, errors (what is left), and the codes."""
    days = log.withColumn("day", local_day("at", zone)).filter(F.col("day").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    hit = refused(F.col("outcome"), F.col("status"))
    counts = days.groupBy("source", "day").agg(F.count("*").alias("sent"), F.count_if((F.col("outcome") == "ok") & ~hit).alias("ok"), F.count_if(hit).alias("refused"))
    spine = sources.select("source").distinct().crossJoin(F.broadcast(day_spine(log.sparkSession, first, last)))  # sources x days, a report's axis
    found = spine.join(counts, ["source", "day"], "left").join(codes_text(days, ["source", "day"]), ["source", "day"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("sent", "ok", "refused")}
    return found.withColumns(zero).select("source", "day", "sent", "ok", "refused", (F.col("sent") - F.col("ok") - F.col("refused")).alias("errors"), F.coalesce("codes", F.lit("")).alias("codes"))


def recent_counts(log: DataFrame, key: str, now: Column, hours: int = 24) -> DataFrame:
    """Requests by key and outcome within the hours before ``now``."""
    late = log.filter((F.col("at") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("at") <= now))
    return late.groupBy(key).agg(F.count("*").alias("requests"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "refused", "error")))


def refusal_share(log: DataFrame, zone: str) -> DataFrame:
    return log.groupBy(local_day("at", zone).alias("day")).agg(F.count("*").alias("requests"), (F.count_if(F.col("outcome") == "refused") / F.count("*")).alias("refused_share"))


def longest_gap(log: DataFrame, key: str) -> DataFrame:
    """The longest time between consecutive requests of a key, in microseconds; null for a single one.

    Gaps within a UTC day are found day by day, so a key with a large share of all rows spreads over its days;
    only each day's first and last moment meet again.
    """
    own = log.select(key, micros("at").alias("t"), F.to_date("at").alias("day"))
    before = F.lag("t").over(Window.partitionBy(key, "day").orderBy("t"))
    days = own.withColumn("gap", F.col("t") - before).groupBy(key, "day").agg(F.max("gap").alias("gap"), F.min("t").alias("first"), F.max("t").alias("last"))
    over = F.col("first") - F.lag("last").over(Window.partitionBy(key).orderBy("day"))
    return days.withColumn("over", over).groupBy(key).agg(F.greatest(F.max("gap"), F.max("over")).alias("gap_us"))


def _refused_share(window: WindowSpec) -> dict[str, Column]:
    n, hit = F.count("*").over(window), F.count_if(F.col("outcome") == "refused").over(window)
    return {"in_window": n, "refused_in": hit, "refused_share": hit / n}


def trailing_share(log: DataFrame, key: str, order: list[str], n: int = 20, block: int = BLOCK) -> DataFrame:
    """Share of refusals among the last ``n`` outcomes up to each request of a key."""
    return trailing(log, key, order, n, lambda w: _refused_share(w.rowsBetween(1 - n, 0)), block=block)


def trailing_share_since(log: DataFrame, key: str, order: list[str], moved: Column, n: int = 20, block: int = BLOCK) -> DataFrame:
    """The same, but the window begins anew after each row that is a move."""
    move = F.coalesce(moved.cast("int"), F.lit(0))
    marked = running(log, key, order, {"_moves": move}).withColumn("_stint", F.col("_moves") - move)
    return trailing(marked, key, order, n, lambda w: _refused_share(w.rowsBetween(1 - n, 0)), within="_stint", block=block).drop("_stint", "_moves")


def rolling_count(log: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Requests of a key in the hours up to each request, that one included."""
    return rolling(log, key, micros("at"), hours * 3_600_000_000, {"rolling": F.lit(1)})


def rolling_bucketed(log: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """The same over whole hours: at most an hour too much, from one row per key and hour."""
    hour = F.floor(micros("at") / F.lit(3_600_000_000)).cast("long")
    per_hour = log.groupBy(key, hour.alias("hour")).agg(F.count("*").alias("n"))
    return per_hour.withColumn("rolling", F.sum("n").over(Window.partitionBy(key).orderBy("hour").rangeBetween(-hours, 0)))


def streaks(log: DataFrame, key: str, order: list[str], outcome: str = "refused") -> DataFrame:
    """The longest run of one outcome per key, and how many runs there are."""
    hit = F.coalesce(F.col("outcome") == outcome, F.lit(False))
    marked = running(log.select(key, "outcome", *(c for c in order if c not in (key, "outcome"))), key, order, {"island": F.when(hit, 0).otherwise(1)})
    runs = marked.filter(hit).groupBy(key, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


def capped_rate(log: DataFrame, key: str, cap_s: int = 3600, block: int = BLOCK) -> DataFrame:
    """Requests per hour of a key, with no gap counting for more than ``cap_s``; in whole microseconds until the last step."""
    before = shifted(log.select(key, micros("at").alias("t")), key, ["t"], {"before": F.col("t")}, block)
    spent = before.withColumn("gap", F.when(F.col("before").isNotNull(), F.least(F.col("t") - F.col("before"), F.lit(cap_s * 1_000_000))))
    return spent.groupBy(key).agg(F.count("*").alias("requests"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("busy_us")).withColumn("per_hour", F.try_divide(F.col("requests") * F.lit(3.6e9), F.col("busy_us")))


def quota_schedule(log: DataFrame, key: str, order: list[str], one_in: int) -> DataFrame:
    """Which picks of a key's log are floor picks: those whose number of picks before is a multiple of ``one_in``."""
    done = F.col("pick") - 1
    return running(log, key, order, {"pick": F.lit(1)}).withColumns({"pick": done.cast("long"), "is_floor": done % one_in == 0})


def running_counts(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``log`` with how many requests and refusals its keys have had up to each row."""
    return running(log, keys, order, {"requests": F.lit(1), "refusals": (F.col("outcome") == "refused").cast("int")})


def provenance(hits: DataFrame, origin: str, strong: Column, direct: Column, least: int = 5, share: float = 0.5) -> DataFrame:
    """Per origin: hits, direct hits, strong ones; suspect with at least ``least`` hits and fewer than ``share`` direct."""
    found = hits.groupBy(origin).agg(F.count("*").alias("hits"), F.count_if(direct).alias("direct"), F.count_if(strong).alias("strong"))
    return found.withColumn("suspect", (F.col("hits") >= least) & (F.col("direct") / F.col("hits") < share))
