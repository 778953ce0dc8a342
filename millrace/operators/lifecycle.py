"""What happens to a posting next: expiry, cheap checks, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.geo import country_of, provisional_tier
from millrace.functions.text import first_keyword
from millrace.functions.timeutil import backoff

Rules = list[tuple[str, Column]]


def first_match(rules: Rules) -> Column:
    """The name of the first rule that holds; an unknown condition doesn't hold. One pass for ordered updates."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in rules))


def expiry_rules(now: Column, first_seen: str = "first_seen", refused_at: str = "first_refused_at", posted_at: str = "posted_at", covered: Column | None = None, days: int = 30, refused_days: int = 7, covered_hours: int = 96) -> Rules:
    """The cascade, in its order: refused too long, posted too long ago, waited too long, covered by the age-out rule."""
    before = lambda c, **age: F.col(c) < now - F.make_dt_interval(**{k: F.lit(v) for k, v in age.items()})
    rules = [("description_refused", before(refused_at, days=refused_days)), ("posting_too_old", before(posted_at, days=days)), ("waited_too_long", before(first_seen, days=days))]
    return rules if covered is None else [*rules, ("aged_out", covered & before(first_seen, hours=covered_hours))]


def expire(df: DataFrame, rules: Rules, waiting: Column) -> DataFrame:
    """Waiting rows that a rule takes become expired, with the rule as reason; others keep stage and reason."""
    reason = F.when(waiting, first_match(rules))
    return df.withColumns({"stage": F.when(reason.isNotNull(), "expired").otherwise(F.col("stage")), "stage_reason": F.coalesce(reason, F.col("stage_reason"))})


def waiting(now: Column) -> Column:
    """Seen, in a tier, with a description still to come and its time reached."""
    return (F.col("stage") == "seen") & F.col("tier").isNotNull() & F.col("description_status").isin("pending", "rate_limited") & (F.col("next_attempt_at") <= now)


def undo(df: DataFrame, reason: str, stage: str) -> DataFrame:
    """Rows that a bulk rule took return to ``stage``."""
    hit = F.coalesce(F.col("stage_reason") == reason, F.lit(False))
    return df.withColumns({"stage": F.when(hit, stage).otherwise(F.col("stage")), "stage_reason": F.when(hit, "").otherwise(F.col("stage_reason"))})


def cheap_checks(df: DataFrame, seen_hashes: DataFrame, keywords: list[str], languages: list[str]) -> DataFrame:
    """Stage, reason and tier after the checks that need no model, the first that holds deciding.

    df: id, url, title, location, tier_hint, language, described; seen_hashes: link_hash (md5 of a link).
    """
    known = seen_hashes.select(F.col("link_hash").alias("_hash")).distinct().withColumn("_known", F.lit(True))
    joined = df.join(known, F.md5("url") == F.col("_hash"), "left").drop("_hash")
    joined = joined.withColumns({"tier": provisional_tier(country_of(F.col("location")), F.col("tier_hint")), "_word": first_keyword(F.col("title"), keywords)})
    reason = first_match(
        [
            ("seen_before_cutover", F.col("_known")),
            ("out_of_scope", F.col("tier").isNull()),
        ]
    )
    reason = F.coalesce(reason, F.when(F.col("_word").isNotNull(), F.concat(F.lit("title_prefilter:"), "_word")), F.when(F.col("described") & F.col("language").isNotNull() & ~F.col("language").isin(*languages), F.concat(F.lit("language:"), "language")))
    stage = F.when(reason.isNotNull(), "filtered_out").when(F.col("described"), "described").otherwise("seen")
    return joined.withColumns({"stage": stage, "stage_reason": F.coalesce(reason, F.lit(""))}).drop("_known", "_word")


def defer(df: DataFrame, hit: Column, attempts: Column, now: Column, base_s: float, cap_s: float) -> DataFrame:
    """Rows that couldn't be done: one more attempt, and the next one after a wait that doubles with each; the stage stays."""
    more = attempts + 1
    later = now + F.make_dt_interval(secs=backoff(more, base_s, cap_s))
    return df.withColumns({"attempts": F.when(hit, more).otherwise(attempts), "next_attempt_at": F.when(hit, later).otherwise(F.col("next_attempt_at"))})


def cheap_selection(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` oldest rows that a pass of cheap checks looks at: seen ones without a tier, or with a description that has come."""
    described = F.coalesce(F.col("description").rlike(r"\S"), F.lit(False))
    return df.filter((F.col("stage") == "seen") & (F.col("tier").isNull() | described)).orderBy(*order).limit(n)


def transitions(log: DataFrame) -> DataFrame:
    """The stage of each row after a log of transitions (id, at, seq, stage, reason)."""
    return log.groupBy("id").agg(F.max(F.struct("at", "seq", "stage", "reason")).alias("t")).select("id", "t.stage", "t.reason", F.col("t.at").alias("stage_changed_at"))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.split_part("stage_reason", F.lit(":"), F.lit(1)).alias("reason")).count()
