"""Report blocks as rows: (section, name, metric, value), one row for each figure, and text lines made of them.

A report has as many rows as it has tiers, sources and classes, whatever the tables behind it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import short_model
from millrace.operators.delivery import threshold_of
from millrace.operators.keys import joined


def figures(df: DataFrame, section: str, name: Column, metrics: dict[str, Column]) -> DataFrame:
    """One row per row of ``df`` and metric; values are doubles, unknown ones null."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()))).alias("f")
    return df.select(F.lit(section).alias("section"), F.coalesce(name.cast("string"), F.lit("-")).alias("name"), each).select("section", "name", "f.metric", "f.value")


def _ago(now: Column, **age: int) -> Column:
    return now - F.make_dt_interval(**{k: F.lit(v) for k, v in age.items()})


def day_summary(jobs: DataFrame, sightings: DataFrame, packages: DataFrame, usage: DataFrame, beats: DataFrame, thresholds: dict[int, float], now: Column, silent_s: int = 3600) -> DataFrame:
    """The 24 hours before ``now``: by tier found, delivered, strong and packaged; new jobs by source; calls by provider; silent services.

    jobs: id, tier, stage, score, delivered_at; sightings: id, source, seen_at; packages: id, packaged_at; usage: provider,
    requests, tokens of the day; beats: service, beat_at.
    """
    since = _ago(now, hours=24)
    late = sightings.filter((F.col("seen_at") >= since) & (F.col("seen_at") <= now))
    found = late.join(jobs.select("id", "tier"), "id").groupBy("tier").agg(F.count("*").alias("found"))
    packed = packages.filter((F.col("packaged_at") >= since) & (F.col("packaged_at") <= now)).join(jobs.select("id", "tier"), "id").groupBy("tier").agg(F.count("*").alias("packaged"))
    sent = (F.col("delivered_at") >= since) & (F.col("delivered_at") <= now)
    tiers = jobs.groupBy("tier").agg(F.count_if(sent).alias("delivered"), F.count_if(sent & (F.col("score") >= threshold_of(F.col("tier"), thresholds))).alias("strong"), F.count_if(F.col("stage").isin("seen", "described")).alias("waiting"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    with_all = joined(joined(tiers, found, ["tier"], "left"), packed, ["tier"], "left")
    silent = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("beat_at").cast("timestamp")) > silent_s
    return (
        figures(with_all, "tier", F.col("tier"), {"found": zero("found"), "delivered": F.col("delivered"), "strong": F.col("strong"), "packaged": zero("packaged"), "waiting": F.col("waiting")})
        .unionByName(figures(late.groupBy("source").agg(F.count("*").alias("n")), "source", F.col("source"), {"found": F.col("n")}))
        .unionByName(figures(usage, "provider", F.col("provider"), {"requests": F.col("requests"), "tokens": F.col("tokens")}))
        .unionByName(figures(beats.groupBy("service").agg(F.max("beat_at").alias("beat_at")), "service", F.col("service"), {"silent": silent.cast("int")}))
    )


def status_view(jobs: DataFrame, slices: DataFrame, waits: Column, now: Column) -> DataFrame:
    """What an operator looks at: jobs by tier and stage, expired by reason in 7 days, the queue by tier and class with its oldest age, slices.

    jobs: tier, stage, stage_reason, stage_changed_at, cls, first_seen; slices: source, active, due_at, walked_at.
    """
    age = lambda c: F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(c).cast("timestamp"))
    stages = jobs.groupBy("tier", "stage").agg(F.count("*").alias("n"), F.max(age("first_seen")).alias("age"))
    reasons = jobs.filter((F.col("stage") == "expired") & (F.col("stage_changed_at") >= _ago(now, days=7))).groupBy("stage_reason").agg(F.count("*").alias("n"))
    queue = jobs.filter(waits).groupBy("tier", "cls").agg(F.count("*").alias("n"), F.max(age("first_seen")).alias("age"))
    due = F.col("active") & (F.col("due_at") <= now)
    walks = slices.groupBy("source").agg(F.count_if("active").alias("active"), F.count_if(due).alias("due"), F.min(age("walked_at")).alias("age"))
    pair = lambda a, b: F.concat_ws("/", F.coalesce(F.col(a).cast("string"), F.lit("-")), F.coalesce(F.col(b).cast("string"), F.lit("unclassified")))
    return (
        figures(stages, "stage", pair("tier", "stage"), {"jobs": F.col("n"), "oldest_s": F.col("age")})
        .unionByName(figures(reasons, "expired", F.col("stage_reason"), {"jobs": F.col("n")}))
        .unionByName(figures(queue, "queue", pair("tier", "cls"), {"jobs": F.col("n"), "oldest_s": F.col("age")}))
        .unionByName(figures(walks, "slices", F.col("source"), {"active": F.col("active"), "due": F.col("due"), "last_walk_s": F.col("age")}))
    )


def day_report(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """A day's runs by tier (last attempts) and its model calls by tier, stage and model, the calls without an answer as one.

    runs: tier, attempts, status, fetched, scored, strong; calls: tier, stage, model, outcome, tokens.
    """
    model = F.coalesce(short_model(F.col("model")), F.lit("no response"))
    used = calls.groupBy("tier", "stage", model.alias("model")).agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") != "ok").alias("failed"), F.sum("tokens").alias("tokens"))
    return figures(runs, "tier", F.col("tier"), {"attempts": F.col("attempts"), "ok": (F.col("status") == "ok").cast("int"), "fetched": F.col("fetched"), "scored": F.col("scored"), "strong": F.col("strong")}).unionByName(
        figures(used, "model", F.concat_ws("/", F.coalesce(F.col("tier").cast("string"), F.lit("-")), "stage", "model"), {"calls": F.col("calls"), "failed": F.col("failed"), "tokens": F.col("tokens")})
    )


def as_lines(rows: DataFrame) -> DataFrame:
    """section, name and a line of a name's figures, in the order of the metrics' names: ``name: a 1, b 2``."""
    number = F.when(F.col("value") == F.floor("value"), F.format_string("%d", F.col("value").cast("long"))).otherwise(F.format_string("%.2f", "value"))
    listed = F.array_sort(F.collect_list(F.struct("metric", F.coalesce(number, F.lit("?")).alias("text"))))  # the metrics of one name
    line = F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["metric"], x["text"])), ", ")
    return rows.groupBy("section", "name").agg(F.concat_ws(": ", F.first("name"), line).alias("line"))


def run_rules(most_429: int = 20, most_deferred: float = 0.05, other_share: float = 0.2, least_other: int = 3, limit_share: float = 0.9) -> list[tuple[str, Column]]:
    """The rules that a run is warned by. Columns: status, later_started, attempts, degraded, batches_failed, telemetry_ok,
    search_429, description_429, given_up, deferred, fetched, answered, other_answers, cut_short, limit_used, limit_per_day."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    return [
        ("not recorded", c("status").isNull()),
        ("crashed", (c("status") == "running") & c("later_started")),
        ("failed", c("status") == "failed"),
        ("several attempts", c("attempts") > 1),
        ("verification degraded", c("degraded")),
        ("verification batches failed", ~F.coalesce(c("degraded"), F.lit(False)) & (c("batches_failed") > 0)),
        ("telemetry incomplete", ~c("telemetry_ok")),
        ("many rate limits", zero("search_429") + zero("description_429") > most_429),
        ("gave up on rate limits", c("given_up") > 0),
        ("many deferred", (c("fetched") > 0) & (c("deferred") / c("fetched") > most_deferred)),
        ("searches cut short", c("cut_short") > 0),
        ("answered by another model", (c("other_answers") >= least_other) & (c("other_answers") / c("answered") > other_share)),
        ("limit nearly used", (c("limit_per_day") > 0) & (c("limit_used") >= limit_share * c("limit_per_day"))),
    ]


def pages_per_area(walks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Walks, pages and mean pages of each area in the hours before ``now``. walks: area, walked_at, pages."""
    recent = walks.filter((F.col("walked_at") > _ago(now, hours=hours)) & (F.col("walked_at") <= now))
    return recent.groupBy("area").agg(F.count("*").alias("walks"), F.sum("pages").alias("pages"), (F.sum("pages") / F.count("*")).alias("mean_pages"))


def late_slices(slices: DataFrame, now: Column, slack_s: int = 0) -> DataFrame:
    """Active slices past their time by more than ``slack_s``, with how long."""
    late = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("due_at").cast("timestamp"))
    return slices.filter("active").withColumn("late_s", late).filter(F.col("late_s") > slack_s)


def stop_reasons(walks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Walks by tier and reason of their stop, in the hours before ``now``."""
    return walks.filter((F.col("walked_at") > _ago(now, hours=hours)) & (F.col("walked_at") <= now)).groupBy("tier", "stop_reason").agg(F.count("*").alias("walks"))
