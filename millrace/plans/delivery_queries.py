"""Queries over orders, line items, events and documents as what is alerted, packaged, delivered and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.timeutil import at
from millrace.operators import delivery, history, model_stage
from millrace.plans.order_queries import TIERED, tiered
from millrace.plans.tables import CALL_LOG, REQUEST_LOG, call_log, request_log, table

NOW = "1998-06-01 00:00:00"
THRESHOLDS = {1: 8, 2: 7, 3: 6}
KINDS = ("search", "description", "packaging")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return tiered(spark, sf_dir).select(
        "id", "tier", "first_seen", F.least(F.lit(10), F.floor(F.col("price") / 40_000) + 1).cast("int").alias("score"),
        F.when(i % 6 == 0, "filtered_out").when(i % 6 == 1, "expired").when(i % 6 == 2, "seen").when(i % 6 == 3, "described").when(i % 6 == 4, "scored").otherwise("delivered").alias("stage"),
        F.when(i % 6 == 0, F.concat(F.lit("language:"), (i % 4).cast("string"))).alias("stage_reason"),
        F.when(i % 5 == 0, "not_stated").when(i % 5 == 1, "confirmed").when(i % 5 == 2, "not_checked").when(i % 5 == 3, "rejected").alias("remote_verdict"),
        F.when(i % 7 == 0, F.col("first_seen")).alias("alerted_at"), F.when(i % 3 == 0, F.col("first_seen")).alias("shown_at"),
    )


JOBS = TIERED + """, jobs AS (
        SELECT id, tier, first_seen, CAST(least(10, floor(price / 40000) + 1) AS INTEGER) AS score,
               CASE id % 6 WHEN 0 THEN 'filtered_out' WHEN 1 THEN 'expired' WHEN 2 THEN 'seen' WHEN 3 THEN 'described' WHEN 4 THEN 'scored' ELSE 'delivered' END AS stage,
               CASE WHEN id % 6 = 0 THEN 'language:' || id % 4 END AS stage_reason,
               CASE id % 5 WHEN 0 THEN 'not_stated' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'not_checked' WHEN 3 THEN 'rejected' END AS remote_verdict,
               CASE WHEN id % 7 = 0 THEN first_seen END AS alerted_at, CASE WHEN id % 3 = 0 THEN first_seen END AS shown_at FROM tiered)"""
_THRESHOLD = "CASE tier WHEN 1 THEN 8 WHEN 2 THEN 7 WHEN 3 THEN 6 END"


def alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.alert_candidates(jobs(spark, sf_dir), THRESHOLDS, [1, 3]).select("id", "tier", "score")


def package_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = jobs(spark, sf_dir).withColumn("note_day", F.to_date("first_seen"))
    failures = own.select("id", (F.col("score") == 9).alias("stopped"), (F.col("first_seen") + F.expr("INTERVAL 20 DAYS")).alias("next_try_at"))
    return delivery.package_candidates(own, own.filter("shown_at IS NOT NULL AND tier = 2"), failures, THRESHOLDS, at(NOW), 60).select("id", "tier", "score")


def delivery_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivery_selection(jobs(spark, sf_dir))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = jobs(spark, sf_dir).withColumn("stage_changed_at", F.col("first_seen"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 5).alias("source"), F.col("l_shipdate").alias("seen_at"))
    return delivery.collection_stats(own, seen, at(NOW), 24 * 30)


def letter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.explode(delivery.letter_violations(text, F.substring_index(text, " ", 1), voice="he|his|him")).alias("rule"))


def note_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    note = delivery.note_text(F.col("p_name"), F.col("p_brand"), {"type": F.col("p_type"), "size": F.when(F.col("p_size") > 10, F.col("p_size"))}, F.col("p_name"))
    return p.select("p_partkey", F.sha2(note, 256).alias("note_sha256"))


def legacy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.migrate(_legacy(spark, sf_dir), "key", "at", "event_id", ["outcome", "status"])


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).withColumn("key", F.when(F.col("digit") != 9, F.concat_ws("/", F.col("source"), F.col("host").cast("string"))))


def migration_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.balance(_legacy(spark, sf_dir), legacy_migration(spark, sf_dir), "key")


def experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = jobs(spark, sf_dir).select("id", F.col("remote_verdict").alias("verdict"), F.when(F.col("id") % 8 != 0, F.col("score")).alias("score"))
    new = stored.select("id", F.when(F.col("id") % 23 != 0, F.col("verdict")).alias("verdict"), (F.col("score") + F.when(F.col("id") % 12 == 0, 2).otherwise(1)).alias("score"))
    return history.compare(stored, new)


def kept_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest_days(request_log(spark, sf_dir), "at", 7).groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("digit") < 4, "search").when(F.col("digit") < 9, "description").otherwise("packaging")
    return history.fresh_turns(request_log(spark, sf_dir).withColumn("kind", kind), "host", ["at", "event_id"], 2, 6 * 3600.0).select("event_id", "kind", F.col("description_run").cast("long").alias("description_run"), "gives_way")


def failed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs scored by a provider that answers some and by another for the rest, as accounting rows per tier."""
    own = jobs(spark, sf_dir).filter("tier is not null")
    ask = lambda keep: lambda rows: rows.filter(keep).select("id", F.col("score").alias("answer"))
    answered = model_stage.with_failover(own, ["id"], {"first": ask("score <= 5"), "second": ask("tier <> 3")})
    return model_stage.call_rows(answered, ["tier"], "scoring", F.col("answer"))


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("outcome") == "timeout", "APITimeoutError").when(F.col("outcome") == "rate_limited", "RateLimitError").when(F.col("outcome") == "error", F.when(F.col("event_id") % 2 == 0, "JSONDecodeError").otherwise("ValueError"))
    message = F.when(F.col("event_id") % 7 == 0, "Daily limit reached").otherwise("x")
    return call_log(spark, sf_dir).groupBy("stage", model_stage.error_kind(error, message).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (alert_candidates, package_candidates, delivery_selection, collection_stats, letter_checks, note_digests, legacy_migration, migration_balance, experiment_metrics, kept_days, turns, failed_over, error_kinds)
}

_LEGACY = REQUEST_LOG + ", legacy AS (SELECT *, CASE WHEN digit <> 9 THEN source || '/' || host END AS key FROM log)"
_BANNED = (
    "excited to", "passionate about", "leverage", "cutting-edge", "delve", "seamless", "fast-paced", "align with your mission", "thrilled", "furthermore", "moreover", "tapestry", "resonates", "the intersection of", "i am writing to",
)
_RULES = " UNION ALL ".join(f"SELECT doc_id, 'banned phrase: {p}' AS rule FROM d WHERE contains(lower(t), '{p}')" for p in _BANNED)

ORACLES = {
    "alert_candidates": f"WITH {JOBS} SELECT id, tier, score FROM jobs WHERE score >= {_THRESHOLD} AND alerted_at IS NULL AND NOT (coalesce(remote_verdict, '') = 'not_stated' AND tier IN (1, 3))",
    "package_candidates": f"""
        WITH {JOBS} SELECT id, tier, score FROM jobs WHERE stage IN ('scored', 'delivered') AND CAST(first_seen AS DATE) >= DATE '{NOW[:10]}' - 60 AND remote_verdict IN ('confirmed', 'not_checked')
        AND score >= {_THRESHOLD} AND NOT (shown_at IS NOT NULL AND tier = 2) AND score <> 9 AND first_seen + INTERVAL 20 DAY <= TIMESTAMP '{NOW}'""",
    "delivery_selection": f"""
        WITH {JOBS} SELECT tier, count(*) FILTER (WHERE stage = 'scored') AS scored, count(*) FILTER (WHERE remote_verdict = 'rejected' AND shown_at IS NULL) AS rejected_new,
               count(*) FILTER (WHERE stage IN ('seen', 'described')) AS waiting FROM jobs GROUP BY 1""",
    "collection_stats": f"""
        WITH {JOBS}, r AS (SELECT *, first_seen >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR AS recent FROM jobs),
        u AS (SELECT tier, 'found' AS metric, CAST(l_suppkey % 5 AS VARCHAR) AS name FROM lineitem JOIN jobs ON l_orderkey = id WHERE l_shipdate >= TIMESTAMP '{NOW}' - INTERVAL 720 HOUR
              UNION ALL SELECT tier, 'filtered', split_part(stage_reason, ':', 1) FROM r WHERE stage = 'filtered_out' AND recent
              UNION ALL SELECT tier, 'expired', NULL FROM r WHERE stage = 'expired' AND recent
              UNION ALL SELECT tier, 'need_description', NULL FROM r WHERE stage = 'seen'
              UNION ALL SELECT tier, 'need_score', NULL FROM r WHERE stage = 'described')
        SELECT tier, metric, name, count(*) AS n FROM u GROUP BY 1, 2, 3""",
    "letter_checks": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) {_RULES}
        UNION ALL SELECT doc_id, 'dash' FROM d WHERE contains(t, '—') OR contains(t, '–') OR contains(t, ' - ')
        UNION ALL SELECT doc_id, 'too long' FROM d WHERE len(regexp_extract_all(t, '\\S+')) > 100
        UNION ALL SELECT doc_id, 'nothing concrete' FROM d WHERE NOT regexp_matches(t, '[0-9]')
        UNION ALL SELECT doc_id, 'opens with the company' FROM d WHERE trim(split_part(t, ' ', 1)) <> '' AND starts_with(lower(trim(t)), lower(trim(split_part(t, ' ', 1))))
        UNION ALL SELECT doc_id, 'third person' FROM d WHERE regexp_matches(t, '(?i)\\b(he|his|him)\\b')""",
    "note_digests": """
        SELECT p_partkey, sha256('---' || chr(10) || 'type: ' || p_type || CASE WHEN p_size > 10 THEN chr(10) || 'size: ' || p_size ELSE '' END || chr(10) || '---' || chr(10) || chr(10)
               || '# ' || p_name || ' at ' || p_brand || chr(10) || chr(10) || p_name || chr(10)) AS note_sha256 FROM part""",
    "legacy_migration": f"""
        WITH {_LEGACY}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen_at DESC, event_id DESC) AS k FROM legacy WHERE key IS NOT NULL)
        SELECT key, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count, max(outcome) FILTER (WHERE k = 1) AS outcome, max(status) FILTER (WHERE k = 1) AS status FROM n GROUP BY 1""",
    "migration_balance": f"""
        WITH {_LEGACY} SELECT count(*) AS rows, count(*) FILTER (WHERE key IS NULL) AS without_key, count(DISTINCT key) AS keys, count(DISTINCT key) AS migrated, count(key) AS seen, true AS balanced FROM legacy""",
    "experiment_metrics": f"""
        WITH {JOBS}, b AS (SELECT remote_verdict AS v, CASE WHEN id % 23 <> 0 THEN remote_verdict END AS w, CASE WHEN id % 8 <> 0 THEN CASE WHEN id % 12 = 0 THEN 2 ELSE 1 END END AS gap FROM jobs),
        c AS (SELECT count(*) AS compared, count(*) FILTER (WHERE v IS NOT DISTINCT FROM w) AS same, count(gap) AS scored, count(*) FILTER (WHERE gap <= 1) AS near FROM b)
        SELECT *, CAST(same AS DOUBLE) / compared AS verdict_agreement, CAST(near AS DOUBLE) / scored AS score_within_one, CAST(same AS DOUBLE) / compared > 0.95 AND CAST(near AS DOUBLE) / scored >= 0.9 AS adopt FROM c""",
    "kept_days": f"WITH {REQUEST_LOG} SELECT CAST(seen_at AS DATE) AS day, count(*) AS n FROM log GROUP BY 1 ORDER BY 1 DESC LIMIT 7",
    "turns": f"""
        WITH {REQUEST_LOG}, k AS (SELECT *, CASE WHEN digit < 4 THEN 'search' WHEN digit < 9 THEN 'description' ELSE 'packaging' END AS kind FROM log),
        m AS (SELECT *, epoch_us(seen_at) - max(epoch_us(seen_at)) FILTER (WHERE kind = 'packaging') OVER w <= 21600000000 AS p, epoch_us(seen_at) - max(epoch_us(seen_at)) FILTER (WHERE kind = 'search') OVER w <= 21600000000 AS s,
                     epoch_us(seen_at) - max(epoch_us(seen_at)) FILTER (WHERE kind = 'description') OVER w <= 21600000000 AS d,
                     count(*) FILTER (WHERE kind <> 'description') OVER (PARTITION BY host ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island
              FROM k WINDOW w AS (PARTITION BY host ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING)),
        r AS (SELECT *, count(*) FILTER (WHERE kind = 'description') OVER (PARTITION BY host, island ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS description_run FROM m)
        SELECT event_id, kind, description_run, CASE WHEN kind = 'packaging' THEN false WHEN coalesce(p, false) THEN true WHEN kind = 'description' THEN coalesce(s, false) AND description_run >= 2
               ELSE coalesce(d, false) AND description_run < 2 END AS gives_way FROM r""",
    "failed_over": f"""
        WITH {JOBS}, a AS (SELECT tier, score, CASE WHEN score <= 5 THEN 'first' WHEN tier <> 3 THEN 'second' END AS provider FROM jobs WHERE tier IS NOT NULL)
        SELECT tier, provider, count(*) AS rows, CAST(sum(score) AS BIGINT) AS tokens, 'scoring' AS stage FROM a WHERE provider IS NOT NULL GROUP BY 1, 2""",
    "error_kinds": f"""
        WITH {CALL_LOG} SELECT stage, CASE WHEN outcome = 'ok' THEN 'ok' WHEN event_id % 7 = 0 THEN 'quota_exhausted' WHEN outcome = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'invalid_output' ELSE 'error' END ELSE outcome END AS kind,
               count(*) AS n FROM calls GROUP BY 1, 2""",
}
