"""What is alerted, packaged and delivered, what was collected, and checks on texts that go out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.keys import joined

# Phrases that a letter must not contain.
BANNED_PHRASES = (
    "excited to", "passionate about", "leverage", "cutting-edge", "delve", "seamless", "fast-paced", "align with your mission", "thrilled", "furthermore", "moreover", "tapestry", "resonates",
    "the intersection of", "i am writing to",
)
# What counts as a dash.
DASHES = ("—", "–", " - ")


def threshold_of(tier: Column, thresholds: dict[int, float]) -> Column:
    """The tier's threshold; null for a tier without one."""
    table = F.create_map(*(F.lit(x) for t, v in thresholds.items() for x in (int(t), float(v))))
    return F.try_element_at(table, tier.cast("int"))


def alert_candidates(df: DataFrame, thresholds: dict[int, float], verifying: Sequence[int]) -> DataFrame:
    """Rows that reach their tier's threshold and were not alerted; a tier that verifies needs a stated verdict.

    df: tier, score, alerted_at, remote_verdict.
    """
    unsure = F.coalesce(F.col("remote_verdict"), F.lit("not_checked")).isin("not_stated", "unconfirmed") & F.col("tier").isin(*verifying)
    return df.filter((F.col("score") >= threshold_of(F.col("tier"), thresholds)) & F.col("alerted_at").isNull() & ~unsure)


def package_candidates(df: DataFrame, applications: DataFrame, failures: DataFrame, thresholds: dict[int, float], now: Column, days: int = 3) -> DataFrame:
    """Scored or delivered rows with a recent note and a remote verdict to rely on, not packaged and not held back by failures.

    df: id, stage, note_day, remote_verdict, tier, score; applications: id; failures: id, stopped, next_try_at.
    """
    ready = F.col("stage").isin("scored", "delivered") & (F.col("note_day") >= F.date_sub(F.to_date(now), days)) & F.col("remote_verdict").isin("confirmed", "not_checked")
    held = failures.filter(F.coalesce("stopped", F.lit(False)) | (F.col("next_try_at") > now)).select("id")
    return df.filter(ready & (F.col("score") >= threshold_of(F.col("tier"), thresholds))).join(applications.select("id"), "id", "left_anti").join(held, "id", "left_anti")


def delivery_selection(df: DataFrame) -> DataFrame:
    """Per tier: rows to deliver, rejected ones not shown yet, and rows still on their way. df: tier, stage, remote_verdict, shown_at."""
    rejected = F.coalesce(F.col("remote_verdict").startswith("rejected"), F.lit(False)) & F.col("shown_at").isNull()
    return df.groupBy("tier").agg(F.count_if(F.col("stage") == "scored").alias("scored"), F.count_if(rejected).alias("rejected_new"), F.count_if(F.col("stage").isin("seen", "described")).alias("waiting"))


def collection_stats(jobs: DataFrame, sightings: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(tier, metric, name, n) of the hours before ``now``: found by source, filtered by reason, expired, and what waits at ``now``.

    jobs: id, tier, stage, stage_reason, stage_changed_at; sightings: id, source, seen_at.
    """
    since = now - F.make_dt_interval(hours=F.lit(hours))
    found = sightings.filter(F.col("seen_at") >= since).join(jobs.select("id", "tier"), "id").select("tier", F.lit("found").alias("metric"), F.col("source").cast("string").alias("name"))
    recent = F.col("stage_changed_at") >= since
    metric = (
        F.when((F.col("stage") == "filtered_out") & recent, "filtered")
        .when((F.col("stage") == "expired") & recent, "expired")
        .when(F.col("stage") == "seen", "need_description")
        .when(F.col("stage") == "described", "need_score")
    )
    name = F.when(metric == "filtered", F.split_part("stage_reason", F.lit(":"), F.lit(1)))
    return found.unionByName(jobs.select("tier", metric.alias("metric"), name.alias("name")).filter("metric is not null")).groupBy("tier", "metric", "name").agg(F.count("*").alias("n"))


def letter_violations(text: Column, company: Column, concrete: str = r"\d", voice: str = "", most_words: int = 100) -> Column:
    """Names of the rules that a letter breaks: banned phrases, dashes, length, nothing concrete, the company first, a wrong voice."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    opens = (F.trim(company) != "") & F.startswith(F.lower(F.trim(text)), F.lower(F.trim(company)))
    found = [F.when(F.contains(F.lower(text), F.lit(p)), F.lit(f"banned phrase: {p}")) for p in BANNED_PHRASES]
    found += [
        F.when(F.coalesce(*(F.when(F.contains(text, F.lit(d)), F.lit(True)) for d in DASHES), F.lit(False)), F.lit("dash")),
        F.when(words > most_words, F.lit("too long")),
        F.when(~text.rlike(f"(?i){concrete}"), F.lit("nothing concrete")),
        F.when(opens, F.lit("opens with the company")),
    ]
    if voice:
        found.append(F.when(text.rlike(f"(?i)\\b({voice})\\b"), F.lit("third person")))
    return F.array_compact(F.array(*found))


def note_text(title: Column, company: Column, fields: dict[str, Column], body: Column) -> Column:
    """A Markdown note: front matter in the given order (nulls left out), heading and body."""
    front = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *front), F.lit("\n---\n\n# "), title, F.lit(" at "), company, F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def manifest(fields: dict[str, Column], hashed: dict[str, Column]) -> Column:
    """A JSON document of fields and the SHA-256 digests of texts."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()), *(F.sha2(v, 256).alias(f"{k}_sha256") for k, v in hashed.items())))


def rejected_lines(rejected: DataFrame, tiers: DataFrame, day: str) -> DataFrame:
    """The audit of what the work-mode check threw out, as the parts (path, n, text) of a file for each tier, also for one without any.

    rejected: id (a whole number from 0 on, the order), tier, title, company, location, url, reason; tiers: tier.
    """
    # The layout of the audit file.
    head = F.format_string("# Rejected by remote verification - %s (tier %s)\n", F.lit(day), F.col("tier").cast("string"))
    none = F.lit("\nNone. Every offer was confirmed, advised or left with its work mode unstated.\n")
    entry = F.concat(F.lit("\n- **"), "title", F.lit(" - "), "company", F.lit("** · "), F.coalesce("location", F.lit("")), F.lit(" · [link]("), F.coalesce("url", F.lit("")), F.lit(")\n  "), F.coalesce("reason", F.lit("")), F.lit("\n"))
    path = F.concat(F.lit(f"{day}/tier"), F.col("tier").cast("string"), F.lit("/rejected.md"))
    every = tiers.select("tier").distinct()
    empty = every.join(rejected.select("tier").distinct(), "tier", "left_anti")
    parts = every.select(path.alias("path"), F.lit(-2).cast("long").alias("n"), head.alias("text"))
    parts = parts.unionByName(empty.select(path.alias("path"), F.lit(-1).cast("long").alias("n"), none.alias("text")))
    return parts.unionByName(rejected.select(path.alias("path"), F.col("id").cast("long").alias("n"), entry.alias("text")))


def sent_progress(progress: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """How far each message (keys) has been sent after a pass over the parts still due, which stops at the first part that didn't get through.

    progress: keys, next, accepted, refused_status; replies: keys, part (from 0), outcome (ok, refused or down), status: what each part would
    get. A refused part never will be accepted and doesn't hold up the rest; one that is down is tried again next time, before any later part.
    """
    due = joined(replies, progress, keys, "left").withColumns({"next": F.coalesce("next", F.lit(0)), "accepted": F.coalesce("accepted", F.lit(0))}).withColumn("due", F.col("part") >= F.col("next"))
    down = F.min(F.when(F.col("due") & (F.col("outcome") == "down"), F.col("part"))).alias("_down")
    stops = due.groupBy(*keys).agg(down, (F.max("part") + 1).alias("parts"))
    sent = joined(due, stops, keys).withColumn("_sent", F.col("due") & (F.col("_down").isNull() | (F.col("part") < F.col("_down"))))
    refused = F.col("_sent") & (F.col("outcome") == "refused")
    found = sent.groupBy(*keys).agg(
        F.max("parts").alias("parts"), F.coalesce(F.max("_down"), F.max("parts")).alias("next"), (F.max("accepted") + F.count_if(F.col("_sent") & (F.col("outcome") == "ok"))).alias("accepted"),
        F.coalesce(F.max("refused_status"), F.min_by(F.when(refused, F.col("status")), F.when(refused, F.col("part")))).alias("refused_status"),
    )
    done = F.col("next") == F.col("parts")
    return found.withColumn("state", F.when(~done, "due").when(F.col("refused_status").isNull(), "sent").otherwise("refused"))
