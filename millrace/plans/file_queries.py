"""Queries that write tables as the files, logs and streams of a running pipeline, in the shared folder, and read them back by the library's scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import delivery
from millrace.plans.running_queries import ORACLES as RUNNING
from millrace.plans.running_queries import rejected_audit
from millrace.plans.tables import REQUEST_LOG, request_log, table
from millrace.sources import logs, store, text_files, walk_pages
from millrace.streaming import expiring, pipelines

LATE = "1 hour"


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as JSON lines, of which refused ones are torn, errors lack their source and a digit of 9 makes a number a word."""
    log = request_log(spark, sf_dir)
    line = F.to_json(F.struct(F.when(F.col("outcome") != "error", F.col("source")).alias("stage"), F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(F.col("digit") == 9, "many").otherwise(F.col("event_id").cast("string")).alias("tokens")))
    plain = F.regexp_replace(line, r'"tokens":"(\d+)"', r'"tokens":$1')
    torn = F.when(F.col("outcome") == "refused", F.substring(plain, 1, 30)).otherwise(plain)
    path = store.shared_path(spark, "lines")
    log.select(torn.alias("value")).write.text(path)
    return logs.json_lines(spark, path, "stage string, timestamp timestamp, tokens long", ["stage", "timestamp", "tokens"])


def json_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _telemetry(spark, sf_dir).select("stage", F.col("timestamp").cast("timestamp_ntz").alias("at"), F.col("tokens").alias("event_id"))


def usage_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _telemetry(spark, sf_dir)
    return logs.used_today(found, "click", "2024-01-05", "tokens").select(F.lit("click").alias("stage"), "tokens").unionByName(logs.used_today(found, "nothing", "2024-01-05", "tokens").select(F.lit("nothing").alias("stage"), "tokens"))


def seen_hash_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links' digests in a text file, with blanks around some and a part missing from others."""
    p, path = table(spark, sf_dir, "pages"), store.shared_path(spark, "hashes")
    digest, n = F.md5("url"), F.length("url") % 5
    p.filter("url IS NOT NULL").select(F.when(n == 0, F.concat(F.lit("  "), digest, F.lit(" "))).when(n == 1, F.substring(digest, 1, 31)).otherwise(digest).alias("value")).write.text(path)
    return logs.seen_hashes(spark, path)


def csv_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as CSV with times two hours ahead of UTC."""
    log, path = request_log(spark, sf_dir), store.shared_path(spark, "csv")
    when = F.concat(F.date_format(F.col("at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02"))
    log.select(F.col("event_id").alias("id"), when.alias("at"), F.col("source").alias("service"), F.lit("search").alias("kind"), "outcome", "status", F.lit(1.0).alias("factor"), F.col("digit").alias("requests_today"), F.lit(75.0).alias("spacing_seconds"), F.lit(None).cast("double").alias("wait_seconds")).write.option("header", True).csv(path)
    return logs.event_csv(spark, path).select("id", F.col("at").cast("timestamp_ntz").alias("seen_at"), "service", "status", "result")


def note_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each brand, written by the sink for texts and scanned again."""
    p, path = table(spark, sf_dir, "part"), store.shared_path(spark, "notes")
    brands = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")))), "\n").alias("body"))
    note = delivery.note_text(F.lit("Parts"), F.col("p_brand"), {"parts": F.col("n"), "none": F.lit(None).cast("string")}, F.col("body"))
    text_files.write_files(brands.select(F.concat("p_brand", F.lit(".md")).alias("path"), F.lit(0).cast("long").alias("n"), note.alias("text")), path)
    return logs.notes(spark, path).select(F.regexp_replace("file", "%23", "#").alias("file"), F.element_at("fields", "parts").cast("long").alias("parts"), "heading", F.sha2("body", 256).alias("body_sha256"))


def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of rejected postings as files, and what they hold."""
    path = store.shared_path(spark, "audit")
    text_files.write_files(rejected_audit(spark, sf_dir), path)
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d\d-\d\d/.*)$", 1).alias("path"), F.length("value").alias("chars"), F.sha2("value", 256).alias("text_sha256"))


def swapped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue that is replaced as a whole, twice; what a reader finds is the last one."""
    o, path = table(spark, sf_dir, "orders"), store.shared_path(spark, "queue")
    store.swap(o.select("o_orderkey"), path)
    store.swap(store.current(spark, path).join(o.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), "o_orderkey"), path)
    return store.current(spark, path)


def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that two runs append to, read for some of its days."""
    log, path = request_log(spark, sf_dir).select("event_id", "at", "host"), store.shared_path(spark, "log")
    for part in ("host % 3 = 0", "host % 3 <> 0"):
        store.append_log(log.filter(part), path, "at")
    return spark.read.parquet(path).filter("day >= DATE '2024-01-10'").groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


def walked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as walks, five turns a page, read by the stream over pages until all are there, in batches of two pages of a walk."""
    c = table(spark, sf_dir, "conversations").withColumn("start", (F.floor(F.col("turn") / 5) * 5).cast("int"))
    size = c.groupBy("conv_id", "start").agg(F.count("*").alias("n"))
    name = F.concat_ws("", F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("start").cast("string"), F.lit("-"), (F.col("start") + F.col("n")).cast("string"), F.lit(".jsonl"))
    parts = c.join(size, ["conv_id", "start"]).select(name.alias("path"), F.col("turn").cast("long").alias("n"), F.concat(F.to_json(F.struct("turn", "role")), F.lit("\n")).alias("text"))
    pages, out = store.shared_path(spark, "walks"), store.shared_path(spark, "cards")
    text_files.write_files(parts, pages)
    stream = walk_pages.walk_cards(spark, pages, 2, f"{out}-state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").start()
    q.processAllAvailable()
    q.stop()
    found = spark.read.schema(walk_pages.SCHEMA).parquet(out)
    return found.select(F.substring("slice", 2, 20).cast("long").alias("conv_id"), "start", "place", F.get_json_object("card", "$.turn").cast("long").alias("turn"), F.get_json_object("card", "$.role").alias("role"))


def _drained(stream: DataFrame) -> DataFrame:
    """All that a stream says about what is there now."""
    spark, out = stream.sparkSession, store.shared_path(stream.sparkSession, "stream")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", expiring.STATE_STORE)
    try:
        pipelines.run_available(stream, out, f"{out}-state").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(out)


def _streamed(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, store.shared_path(df.sparkSession, "events")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts about refusals of a host, repeated after six hours, and recoveries after a day without one, by the stream with timers."""
    log = request_log(spark, sf_dir).filter("outcome = 'refused'").select(F.col("host").cast("string").alias("key"), F.date_trunc("SECOND", F.col("at").cast("timestamp")).alias("at"), "event_id")
    found = _drained(expiring.alerts_and_recoveries(_streamed(log), 6 * 3600, 24 * 3600, LATE))
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


def deferral_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a host as tries of a link: refusals are deferred as throttled, errors for scoring, and a success ends both."""
    log = request_log(spark, sf_dir).select(F.col("host").cast("string").alias("link"), "outcome", F.date_trunc("SECOND", F.col("at").cast("timestamp")).alias("at"))
    kinds = F.when(F.col("outcome") == "refused", F.array(F.lit("throttled"))).when(F.col("outcome") == "error", F.array(F.lit("scoring"))).otherwise(F.array(F.lit("throttled"), F.lit("scoring")))
    tries = log.select("link", F.explode(kinds).alias("kind"), F.when(F.col("outcome") == "ok", "done").otherwise("failed").alias("outcome"), "at").groupBy("link", "kind", "at").agg(F.max("outcome").alias("outcome"))
    found = _drained(expiring.deferred(_streamed(tries), 3, 2, "Europe/Rome", LATE))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("queued_at", "at")})


QUERIES = {f.__name__: f for f in (json_line_scan, usage_of_a_day, seen_hash_scan, csv_log_scan, note_scan, audit_files, swapped_table, daily_log, walked_cards, alert_events, deferral_events)}

_LINES = "lines AS (SELECT source AS stage, date_trunc('second', seen_at) AS ts, event_id FROM log WHERE outcome = 'ok' AND digit <> 9 AND source IS NOT NULL)"

ORACLES = {
    "json_line_scan": f"WITH {REQUEST_LOG}, {_LINES} SELECT stage, ts AS \"at\", event_id FROM lines",
    "usage_of_a_day": f"WITH {REQUEST_LOG}, {_LINES} SELECT 'click' AS stage, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS tokens FROM lines WHERE stage = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05' UNION ALL SELECT 'nothing', 0",
    "seen_hash_scan": "SELECT DISTINCT md5(url) AS link_hash FROM pages WHERE url IS NOT NULL AND length(url) % 5 <> 1",
    "csv_log_scan": f"WITH {REQUEST_LOG} SELECT event_id AS id, seen_at, source AS service, status, CASE outcome WHEN 'ok' THEN 'clean' WHEN 'refused' THEN 'refused' ELSE 'neutral' END AS result FROM log",
    "note_scan": "SELECT p_brand || '.md' AS file, count(*) AS parts, 'Parts at ' || p_brand AS heading, sha256(string_agg('- ' || p_name || ' ' || p_partkey, chr(10) ORDER BY encode('- ' || p_name || ' ' || p_partkey))) AS body_sha256 FROM part GROUP BY p_brand",
    "audit_files": f"WITH parts AS ({RUNNING['rejected_audit']}) SELECT path, CAST(length(string_agg(text, '' ORDER BY n)) AS INTEGER) AS chars, sha256(string_agg(text, '' ORDER BY n)) AS text_sha256 FROM parts GROUP BY path",
    "swapped_table": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "daily_log": f"WITH {REQUEST_LOG} SELECT CAST(seen_at AS DATE) AS day, count(*) AS n, count(DISTINCT host) AS hosts FROM log WHERE seen_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1",
    "walked_cards": "SELECT conv_id, CAST(turn // 5 * 5 AS BIGINT) AS start, CAST(turn % 5 AS INTEGER) AS place, CAST(turn AS BIGINT) AS turn, role FROM conversations",
    # a stint ends where a day without a refusal begins
    "alert_events": f"""
        WITH RECURSIVE {REQUEST_LOG}, bad AS (SELECT CAST(host AS VARCHAR) AS key, date_trunc('second', seen_at) AS ts, event_id FROM log WHERE outcome = 'refused'),
        last AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM bad),
        g AS (SELECT *, lead(ts) OVER w AS later, coalesce(ts - lag(ts) OVER w >= INTERVAL 24 HOUR, false) AS anew FROM bad WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
        i AS (SELECT *, count(*) FILTER (WHERE anew) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stint FROM g),
        s AS (SELECT key, stint, min(ts) AS t FROM i GROUP BY 1, 2 UNION ALL SELECT i.key, i.stint, min(i.ts) FROM s JOIN i ON i.key = s.key AND i.stint = s.stint AND i.ts >= s.t + INTERVAL 6 HOUR GROUP BY 1, 2)
        SELECT i.key, min(event_id) AS event_id, 'sent' AS event, t AS "at" FROM i JOIN s ON i.key = s.key AND i.stint = s.stint AND i.ts = s.t GROUP BY i.key, t
        UNION ALL SELECT key, NULL, 'recovered', ts + INTERVAL 24 HOUR FROM g, last WHERE later - ts >= INTERVAL 24 HOUR OR later IS NULL AND ts + INTERVAL 24 HOUR <= mark""",
    # one step for each try of a link and kind; two calendar days in Rome, where it is an hour ahead of UTC in January
    "deferral_events": f"""
        WITH RECURSIVE {REQUEST_LOG}, t AS (SELECT CAST(host AS VARCHAR) AS link, unnest(CASE outcome WHEN 'refused' THEN ['throttled'] WHEN 'error' THEN ['scoring'] ELSE ['throttled', 'scoring'] END) AS kind,
                        CASE WHEN outcome = 'ok' THEN 'done' ELSE 'failed' END AS outcome, date_trunc('second', seen_at) AS ts FROM log),
        u AS (SELECT link, kind, ts, max(outcome) AS outcome FROM t GROUP BY 1, 2, 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY link, kind ORDER BY ts) AS k FROM u), last AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM u),
        walk AS (SELECT DISTINCT link, kind, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS q, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS TIMESTAMP) AS held, false AS over FROM n
            UNION ALL
            SELECT link, kind, k, CASE WHEN outcome = 'done' THEN NULL WHEN q IS NULL OR over THEN ts ELSE q END, ts, outcome, q, over FROM (
                SELECT n.*, w.q, coalesce(n.ts >= CASE WHEN n.kind = 'throttled' THEN CAST(CAST(w.q + INTERVAL 1 HOUR AS DATE) + 2 AS TIMESTAMP) - INTERVAL 1 HOUR ELSE w.q + INTERVAL 3 DAY END, false) AS over
                FROM walk w JOIN n ON n.link = w.link AND n.kind = w.kind AND n.k = w.k + 1)),
        ends AS (SELECT link, kind, q, k, CASE WHEN kind = 'throttled' THEN CAST(CAST(q + INTERVAL 1 HOUR AS DATE) + 2 AS TIMESTAMP) - INTERVAL 1 HOUR ELSE q + INTERVAL 3 DAY END AS e FROM walk)
        SELECT link, kind, 'queued' AS event, ts AS queued_at, ts AS "at" FROM walk WHERE outcome = 'failed' AND (held IS NULL OR over)
        UNION ALL SELECT link, kind, 'done', held, ts FROM walk WHERE outcome = 'done' AND held IS NOT NULL AND NOT over
        UNION ALL SELECT link, kind, 'expired', held, CASE WHEN kind = 'throttled' THEN CAST(CAST(held + INTERVAL 1 HOUR AS DATE) + 2 AS TIMESTAMP) - INTERVAL 1 HOUR ELSE held + INTERVAL 3 DAY END FROM walk WHERE over
        UNION ALL SELECT link, kind, 'expired', q, e FROM ends, last WHERE q IS NOT NULL AND e <= mark AND (link, kind, k) IN (SELECT (link, kind, max(k)) FROM n GROUP BY link, kind)""",
}
