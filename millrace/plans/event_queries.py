"""Queries over ``events`` as a request log and as a log of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import wilson_upper
from millrace.functions.timeutil import at, local_day, micros, next_interval, open_seconds, window_seconds
from millrace.operators import calls, health, ladder, requests, trend
from millrace.plans.tables import CALL_LOG, REQUEST_LOG, call_log, request_log

ZONE, FIRST, LAST, NOW = "Europe/Rome", "2024-01-01", "2024-01-31", "2024-01-20 12:00:00"
LOCAL_DAY = f"CAST((seen_at AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE)"


def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir)
    return requests.daily_requests(log, FIRST, LAST, ZONE, log.select("source"))


def request_code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.codes_text(request_log(spark, sf_dir), ["source"])


def requests_by_kind_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.recent_counts(request_log(spark, sf_dir), "source", at(NOW))


def refusal_rate_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.refusal_share(request_log(spark, sf_dir), ZONE)


def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.longest_gap(request_log(spark, sf_dir), "source")


def trailing20_refused_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.trailing_share(request_log(spark, sf_dir), "host", ["at", "event_id"]).select("event_id", "host", "in_window", "refused_in", "refused_share")


def rolling24h_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.rolling_count(request_log(spark, sf_dir), "host").select("event_id", "host", "rolling")


def rolling24h_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.rolling_bucketed(request_log(spark, sf_dir), "source")


def refusal_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.streaks(request_log(spark, sf_dir), "host", ["at", "event_id"])


def rate_with_capped_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.capped_rate(request_log(spark, sf_dir), "host")


def wilson_upper_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = request_log(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("outcome") == "refused").alias("refused"), F.count("*").alias("requests"))
    return found.withColumn("upper", F.round(wilson_upper(F.col("refused"), F.col("requests")), 9))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls.latency_report(call_log(spark, sf_dir), ["stage"], ["ok", "timeout", "rate_limited", "error"])
    return found.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


def model_stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.stage_rows(call_log(spark, sf_dir), ["stage"])


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.latest_by(request_log(spark, sf_dir), ["host"], ["at", "event_id"], ["source", "outcome"])


def silent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = call_log(spark, sf_dir)
    return calls.silent(log.withColumn("stage_host", F.concat_ws("/", "stage", F.col("host") % 20)), "stage_host", at(NOW), F.col("outcome") == "ok", hours=4, back=12)


def fallback_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.fallback_share(call_log(spark, sf_dir), "stage", F.lit("primary-m"))


def limit_usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = call_log(spark, sf_dir).withColumn("day", F.to_date("at"))
    return calls.limit_use(log, ["day"], 100_000, order=["at", "event_id"])


def alert_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = request_log(spark, sf_dir).filter("outcome = 'refused'")
    return calls.suppressed(bad, "host", 6 * 3_600_000_000).select("event_id", "host", "is_suppressed")


def alert_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = request_log(spark, sf_dir).filter("outcome = 'refused'").select(F.col("host").cast("string").alias("key"), "at", "event_id")
    return health.ledger(bad, 6 * 3600)


def budget_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = call_log(spark, sf_dir).select(F.to_date("at").alias("day"), F.col("stage").alias("provider"), F.lit(1).cast("long").alias("requests"), "tokens", "at")
    split = at("2024-01-15 00:00:00")
    state = log.filter(F.col("at") < split).groupBy("day", "provider").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))
    return calls.additive_upsert(state, log.filter(F.col("at") >= split), ["day", "provider"], ["requests", "tokens"])


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = request_log(spark, sf_dir).groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "refused").alias("refused"))
    return trend.before_after(days, "2024-01-16", ["requests", "refused"])


def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir)
    runs = log.groupBy("host", F.to_date("at").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") == 429).alias("too_many"), F.count_if(F.col("outcome") == "error").alias("failed"))
    return trend.warnings(
        runs,
        ["host", "day"],
        [
            ("rate limits above 1", F.col("too_many") > 1),
            ("failed share above 40 %", F.col("failed") / F.col("requests") > 0.4),
            ("no success", F.col("too_many") + F.col("failed") == F.col("requests")),
        ],
    )


def heartbeat_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.liveness(request_log(spark, sf_dir), "host", at("2024-01-30 00:00:00"), 24 * 3600)


def open_seconds_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = request_log(spark, sf_dir).groupBy("host").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return last.select("host", F.round(open_seconds(F.col("first_at"), F.col("last_at"), 2 * 3600, 6 * 3600), 3).alias("open_s"))


def walk_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = request_log(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    stop = F.when(F.col("n") % 4 == 0, "cap_hit").when(F.col("n") % 4 == 1, "known_page").when(F.col("n") % 4 == 2, "error").otherwise("end_of_results")
    walks = walks.withColumn("stop", stop)
    found = next_interval(F.lit(48), F.col("n") % 37 + 12, F.col("stop"), F.col("n") % 5)
    return walks.select("host", "stop", found.alias("hours"), window_seconds(F.col("last_at"), at("2024-01-31 00:00:00")).alias("window_s"))


def day_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and refusals since the local day began, at every request of a host."""
    log = request_log(spark, sf_dir).withColumn("day", local_day("at", ZONE))
    counted = requests.running_counts(log, ["host", "day"], ["at", "event_id"])
    return counted.select("event_id", "day", F.col("requests").alias("requests_today"), F.col("refusals").alias("refusals_today"))


def ladder_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are local ones; a missing status counts as a connection error."""
    log = request_log(spark, sf_dir)
    outcome = F.when(F.col("outcome") == "ok", "clean").when(F.col("outcome") == "refused", "refused").otherwise("neutral")
    block = F.when(F.col("digit") == 3, "connection")
    events = log.select(F.col("host").cast("string").alias("host"), (micros("at") / 1e6).alias("t"), F.unix_date(local_day("at", ZONE)).alias("day"), "event_id", outcome.alias("outcome"), block.alias("block"))
    return ladder.replay(events, ladder.Policy(), ladder.Signals(), level=3)


QUERIES = {
    f.__name__: f
    for f in (
        daily_requests, request_code_histogram, requests_by_kind_24h, refusal_rate_per_day, longest_gap, trailing20_refused_share, rolling24h_requests, rolling24h_bucketed, refusal_streaks,
        rate_with_capped_gap, wilson_upper_by_kind, latency_percentiles, model_stage_rows, latest_event_per_user, silent_kinds, fallback_share, limit_usage_by_day, alert_suppression, alert_ledger,
        budget_upsert, before_after, run_warnings, heartbeat_ages, open_seconds_by_gap, walk_intervals, day_counters, ladder_replay,
    )
}

_CODE = "CASE WHEN status IS NOT NULL THEN CAST(status AS VARCHAR) WHEN outcome = 'ok' THEN 'nocode' ELSE 'none' END"
_PLACE = "CASE code WHEN 'nocode' THEN 1000000 WHEN 'none' THEN 1000001 ELSE CAST(code AS INTEGER) END"

ORACLES = {
    "daily_requests": f"""
        WITH {REQUEST_LOG}, days AS (SELECT *, {LOCAL_DAY} AS day FROM log),
        counts AS (SELECT source, day, count(*) AS sent, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'refused') AS refused
                   FROM days WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY 1, 2),
        codes AS (SELECT source, day, {_CODE} AS code, count(*) AS n FROM days GROUP BY 1, 2, 3),
        texts AS (SELECT source, day, string_agg(code || ':' || n, ' ' ORDER BY {_PLACE}) AS codes FROM codes GROUP BY 1, 2),
        spine AS (SELECT source, CAST(d AS DATE) AS day FROM (SELECT DISTINCT source FROM log), generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) AS g(d))
        SELECT source, day, coalesce(sent, 0) AS sent, coalesce(ok, 0) AS ok, coalesce(refused, 0) AS refused,
               coalesce(sent, 0) - coalesce(ok, 0) - coalesce(refused, 0) AS errors, coalesce(codes, '') AS codes
        FROM spine LEFT JOIN counts USING (source, day) LEFT JOIN texts USING (source, day)""",
    "request_code_histogram": f"""
        WITH {REQUEST_LOG}, codes AS (SELECT source, {_CODE} AS code, count(*) AS n FROM log GROUP BY 1, 2)
        SELECT source, string_agg(code || ':' || n, ' ' ORDER BY {_PLACE}) AS codes FROM codes GROUP BY 1""",
    "requests_by_kind_24h": f"""
        WITH {REQUEST_LOG}
        SELECT source, count(*) AS requests, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'refused') AS refused, count(*) FILTER (WHERE outcome = 'error') AS error
        FROM log WHERE seen_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND seen_at <= TIMESTAMP '{NOW}' GROUP BY 1""",
    "refusal_rate_per_day": f"""
        WITH {REQUEST_LOG}
        SELECT {LOCAL_DAY} AS day, count(*) AS requests, CAST(count(*) FILTER (WHERE outcome = 'refused') AS DOUBLE) / count(*) AS refused_share FROM log GROUP BY 1""",
    "longest_gap": f"""
        WITH {REQUEST_LOG}, gaps AS (SELECT source, epoch_us(seen_at) - lag(epoch_us(seen_at)) OVER (PARTITION BY source ORDER BY seen_at) AS g FROM log)
        SELECT source, max(g) AS gap_us FROM gaps GROUP BY 1""",
    "trailing20_refused_share": f"""
        WITH {REQUEST_LOG}, w AS (SELECT event_id, host, count(*) OVER x AS in_window, count(*) FILTER (WHERE outcome = 'refused') OVER x AS refused_in FROM log
            WINDOW x AS (PARTITION BY host ORDER BY seen_at, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
        SELECT *, CAST(refused_in AS DOUBLE) / in_window AS refused_share FROM w""",
    "rolling24h_requests": f"""
        WITH {REQUEST_LOG}
        SELECT event_id, host, count(*) OVER (PARTITION BY host ORDER BY epoch_us(seen_at) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS rolling FROM log""",
    "rolling24h_bucketed": f"""
        WITH {REQUEST_LOG}, h AS (SELECT source, epoch_us(seen_at) // 3600000000 AS hour, count(*) AS n FROM log GROUP BY 1, 2)
        SELECT source, hour, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY hour RANGE BETWEEN 24 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM h""",
    "refusal_streaks": f"""
        WITH {REQUEST_LOG}, m AS (SELECT host, outcome, sum(CASE WHEN outcome = 'refused' THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM log),
        r AS (SELECT host, island, count(*) AS n FROM m WHERE outcome = 'refused' GROUP BY 1, 2)
        SELECT host, max(n) AS longest, count(*) AS runs FROM r GROUP BY 1""",
    "rate_with_capped_gap": f"""
        WITH {REQUEST_LOG}, g AS (SELECT host, least(epoch_us(seen_at) - lag(epoch_us(seen_at)) OVER (PARTITION BY host ORDER BY seen_at), CASE WHEN lag(seen_at) OVER (PARTITION BY host ORDER BY seen_at) IS NULL THEN NULL ELSE 3600000000 END) AS gap FROM log),
        s AS (SELECT host, count(*) AS requests, CAST(coalesce(sum(gap), 0) AS BIGINT) AS busy_us FROM g GROUP BY 1)
        SELECT *, CASE WHEN busy_us <> 0 THEN requests * CAST(3.6e9 AS DOUBLE) / busy_us END AS per_hour FROM s""",
    "wilson_upper_by_kind": f"""
        WITH {REQUEST_LOG}, c AS (SELECT source, count(*) FILTER (WHERE outcome = 'refused') AS refused, count(*) AS requests FROM log GROUP BY 1),
        p AS (SELECT *, CAST(refused AS DOUBLE) / requests AS p, CAST(1.96 AS DOUBLE) AS z FROM c)
        SELECT source, refused, requests, round(least(1, (p + z * z / (2 * requests) + z * sqrt(p * (1 - p) / requests + z * z / (4.0 * requests * requests))) / (1 + z * z / requests)), 9) AS upper FROM p""",
    "latency_percentiles": f"""
        WITH {CALL_LOG}
        SELECT stage, count(*) AS calls, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95,
               count(*) FILTER (WHERE outcome = 'ok') AS n_ok, count(*) FILTER (WHERE outcome = 'timeout') AS n_timeout,
               count(*) FILTER (WHERE outcome = 'rate_limited') AS n_rate_limited, count(*) FILTER (WHERE outcome = 'error') AS n_error
        FROM calls GROUP BY 1""",
    "model_stage_rows": f"""
        WITH {CALL_LOG} SELECT stage, coalesce(model, 'no response') AS model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1, 2""",
    "latest_event_per_user": f"""
        WITH {REQUEST_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seen_at DESC, event_id DESC) AS n FROM log)
        SELECT host, seen_at AS "at", event_id, source, outcome FROM r WHERE n = 1""",
    "silent_kinds": f"""
        WITH {CALL_LOG}, recent AS (SELECT concat(stage, '/', host % 20) AS stage_host, seen_at, outcome FROM calls WHERE seen_at > TIMESTAMP '{NOW}' - INTERVAL 12 HOUR AND seen_at <= TIMESTAMP '{NOW}'),
        l AS (SELECT stage_host, max(seen_at) FILTER (WHERE outcome = 'ok') AS answered FROM recent GROUP BY 1)
        SELECT r.stage_host, min(r.seen_at) AS since, max(r.seen_at) AS last_call, count(*) AS calls FROM recent r JOIN l USING (stage_host)
        WHERE l.answered IS NULL OR r.seen_at > l.answered GROUP BY 1
        HAVING min(r.seen_at) <= TIMESTAMP '{NOW}' - INTERVAL 4 HOUR AND max(r.seen_at) > TIMESTAMP '{NOW}' - INTERVAL 4 HOUR""",
    "fallback_share": f"""
        WITH {CALL_LOG}, c AS (SELECT stage, count(*) AS calls, count(*) FILTER (WHERE model IS NULL) AS unanswered, count(*) FILTER (WHERE model <> 'primary-m') AS other FROM calls GROUP BY 1)
        SELECT *, CAST(other AS DOUBLE) / nullif(calls - unanswered, 0) AS fallback_share,
               calls - unanswered >= 5 AND coalesce(CAST(other AS DOUBLE) / nullif(calls - unanswered, 0) > 0.2, false) AS warns FROM c""",
    "limit_usage_by_day": f"""
        WITH {CALL_LOG}, u AS (SELECT CAST(seen_at AS DATE) AS day, tokens, sum(tokens) OVER (PARTITION BY CAST(seen_at AS DATE) ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING) AS used FROM calls)
        SELECT day, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE used <= 100000) AS within, CAST(sum(tokens) AS DOUBLE) / 100000 AS limit_share FROM u GROUP BY 1""",
    "alert_suppression": f"""
        WITH {REQUEST_LOG}
        SELECT event_id, host, coalesce(epoch_us(seen_at) - lag(epoch_us(seen_at)) OVER (PARTITION BY host ORDER BY seen_at) < 21600000000, false) AS is_suppressed FROM log WHERE outcome = 'refused'""",
    "alert_ledger": f"""
        WITH RECURSIVE {REQUEST_LOG}, bad AS (SELECT CAST(host AS VARCHAR) AS key, seen_at, event_id FROM log WHERE outcome = 'refused'),
        s AS (SELECT key, min(seen_at) AS t FROM bad GROUP BY 1 UNION ALL SELECT b.key, min(b.seen_at) FROM s JOIN bad b ON b.key = s.key AND b.seen_at >= s.t + INTERVAL 6 HOUR GROUP BY 1),
        x AS (SELECT min(b.event_id) AS event_id FROM bad b JOIN s ON b.key = s.key AND b.seen_at = s.t GROUP BY b.key, s.t)
        SELECT key, event_id, event_id IN (SELECT event_id FROM x) AS sent FROM bad""",
    "budget_upsert": f"""
        WITH {CALL_LOG} SELECT CAST(seen_at AS DATE) AS day, stage AS provider, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1, 2""",
    "before_after": f"""
        WITH {REQUEST_LOG}, d AS (SELECT CAST(seen_at AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE outcome = 'refused') AS refused FROM log GROUP BY 1),
        u AS (SELECT day, unnest(['requests', 'refused']) AS metric, unnest([requests, refused]) AS v FROM d),
        s AS (SELECT metric, count(*) FILTER (WHERE day < DATE '2024-01-16') AS days_before, count(*) FILTER (WHERE day >= DATE '2024-01-16') AS days_after,
                     CAST(sum(v) FILTER (WHERE day < DATE '2024-01-16') AS DOUBLE) / count(*) FILTER (WHERE day < DATE '2024-01-16') AS before_avg,
                     CAST(sum(v) FILTER (WHERE day >= DATE '2024-01-16') AS DOUBLE) / count(*) FILTER (WHERE day >= DATE '2024-01-16') AS after_avg FROM u GROUP BY 1)
        SELECT metric, days_before, days_after, round(before_avg, 6) AS before_avg, round(after_avg, 6) AS after_avg, round((after_avg - before_avg) * 100 / before_avg, 6) AS change_pct,
               least(days_before, days_after) < 5 AS indicative_only FROM s""",
    "run_warnings": f"""
        WITH {REQUEST_LOG}, r AS (SELECT host, CAST(seen_at AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE status = 429) AS too_many, count(*) FILTER (WHERE outcome = 'error') AS failed FROM log GROUP BY 1, 2)
        SELECT host, day, 'rate limits above 1' AS warning FROM r WHERE too_many > 1
        UNION ALL SELECT host, day, 'failed share above 40 %' FROM r WHERE CAST(failed AS DOUBLE) / requests > 0.4
        UNION ALL SELECT host, day, 'no success' FROM r WHERE too_many + failed = requests""",
    "heartbeat_ages": f"""
        WITH {REQUEST_LOG}
        SELECT host, max(seen_at) AS beat_at, epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(max(seen_at)) AS age_us, epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(max(seen_at)) > 86400000000 AS is_silent FROM log GROUP BY 1""",
    "open_seconds_by_gap": f"""
        WITH {REQUEST_LOG}, l AS (SELECT host, epoch_us(min(seen_at)) AS a, epoch_us(max(seen_at)) AS b, CAST(min(seen_at) AS DATE) AS d1, CAST(max(seen_at) AS DATE) AS d2 FROM log GROUP BY 1),
        d AS (SELECT host, a, b, epoch_us(unnest(generate_series(CAST(d1 AS TIMESTAMP), CAST(d2 AS TIMESTAMP), INTERVAL 1 DAY))) AS m FROM l),
        s AS (SELECT host, a, b, sum(greatest(0, least(b, m + 21600000000) - greatest(a, m + 7200000000))) AS shut FROM d GROUP BY 1, 2, 3)
        SELECT host, round(CASE WHEN b > a THEN CAST(b - a - shut AS DOUBLE) / 1000000 ELSE 0 END, 3) AS open_s FROM s""",
    "walk_intervals": f"""
        WITH {REQUEST_LOG}, w AS (SELECT host, count(*) AS n, max(seen_at) AS last_at FROM log GROUP BY 1),
        s AS (SELECT *, CASE n % 4 WHEN 0 THEN 'cap_hit' WHEN 1 THEN 'known_page' WHEN 2 THEN 'error' ELSE 'end_of_results' END AS stop, n % 37 + 12 AS cur FROM w),
        m AS (SELECT *, CASE stop WHEN 'cap_hit' THEN greatest(12, cur // 2) WHEN 'error' THEN cur ELSE least(48, cur * 2) END AS moved FROM s)
        SELECT host, stop, CAST(least(48, greatest(12, CASE WHEN n % 5 >= 3 THEN greatest(moved, 24) ELSE moved END)) AS BIGINT) AS hours,
               CAST(least(greatest(0, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_at)) // 1000000) + 7200, 604800) AS BIGINT) AS window_s FROM m""",
    "day_counters": f"""
        WITH {REQUEST_LOG}, d AS (SELECT *, {LOCAL_DAY} AS day FROM log)
        SELECT event_id, day, count(*) OVER w AS requests_today, count(*) FILTER (WHERE outcome = 'refused') OVER w AS refusals_today FROM d
        WINDOW w AS (PARTITION BY host, day ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING)""",
}
