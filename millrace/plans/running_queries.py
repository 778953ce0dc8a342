"""Queries over running budgets, sendings, audits, assembled documents, languages, title ranks and functions used from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import geo, languages, register, stats, timeutil
from millrace.functions.timeutil import at
from millrace.operators import calls, cv, delivery, lifecycle, model_stage, queueing, rules, trend
from millrace.operators.queueing import TitleClass
from millrace.plans.delivery_queries import JOBS, jobs
from millrace.plans.order_queries import TIERED, tiered
from millrace.plans.tables import CALL_LOG, REQUEST_LOG, call_log, request_log, table
from millrace.sources import store

DAY = "1998-06-01"


def running_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = call_log(spark, sf_dir).withColumn("day", F.to_date("at"))
    found = calls.running_gates(log, ["day"], ["at", "event_id"], 300, 100_000, 3600, 8_000, "click", 0.4)
    return found.select("event_id", "requests_before", "stage_before", "tokens_before", "window_before", "may_call")


def degraded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = call_log(spark, sf_dir).withColumn("day", F.to_date("at"))
    return calls.degraded_runs(log, ["day"], ["stage", "host"], F.col("outcome") == "ok", 0.25)


def _shared_failover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings of a year as due rows: the first provider takes 4/10 of 500 of a year, the second what it can of the others."""
    own = jobs(spark, sf_dir).filter("tier IS NOT NULL").select("id", "tier", "score", F.year("first_seen").alias("year"), F.col("first_seen"))
    ask = lambda keep: lambda rows: rows.filter(keep).select("id", F.col("score").alias("answer"))
    told = model_stage.with_failover(own, ["id"], {"first": ask("score <= 7"), "second": ask("tier <> 3"), "third": ask("score = 9")}, {"first": 500 * 4 // 10, "third": 20}, ["first_seen", "id"], ["year"])
    return own, told


def shared_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared_failover(spark, sf_dir)[1].groupBy("year", "provider").agg(F.count("*").alias("n"), F.sum("answer").alias("points"), F.max("first_seen").alias("last"))


def degraded_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, told = _shared_failover(spark, sf_dir)
    return model_stage.stage_state(own.withColumn("batch", F.floor(F.col("id") / 4)), told, ["id"], ["batch"], ["year"], 0.05)


def rejected_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each tier's audit file, by postings whose verdict is a rejection."""
    j = jobs(spark, sf_dir).filter("tier IS NOT NULL")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("company"))
    out = j.filter("remote_verdict = 'rejected' AND tier <> 5").join(o, "id").select("id", "tier", F.concat(F.lit("Job "), F.col("id").cast("string")).alias("title"), "company", F.col("stage").alias("location"), F.lit(None).cast("string").alias("url"), F.col("stage_reason").alias("reason"))
    return delivery.rejected_lines(out, j.select("tier"), DAY)


def message_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages of several parts; how a part's length ends decides what becomes of it, and the first part of some has been sent."""
    c = table(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    replies = c.select("conv_id", F.col("turn").cast("long").alias("part"), F.when(n % 10 == 7, "refused").when(n % 10 == 3, "down").otherwise("ok").alias("outcome"), F.when(n % 10 == 7, 400 + n % 4).alias("status"))
    done = c.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, n)).alias("n")).filter("n % 2 = 0").select("conv_id", F.lit(1).cast("long").alias("next"), F.lit(1).cast("long").alias("accepted"), F.lit(None).cast("int").alias("refused_status"))
    return delivery.sent_progress(done, replies, ["conv_id"])


def _brand_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    entry = F.concat(F.lit("**"), "p_type", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("**\n  - Built "), "p_name", F.lit(" \n- sold 3 "), "p_name")
    return p.groupBy("p_brand").agg(F.concat(F.lit("# Name\r\n\n## Summary\nShort.\n- a point\n\n## Experience\n"), F.array_join(F.array_sort(F.collect_list(entry)), "\n\n"), F.lit("\n\n## Skills\n**Tools:** all\n- lp.one :: proof\n")).alias("text"))


def cv_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each brand, with the two bullets of every role changing places; the rest is as it was."""
    docs = _brand_cvs(spark, sf_dir)
    lines = cv._slots(docs, "p_brand", "text").filter("place IS NOT NULL")
    plan = lines.select("p_brand", "role_no", (3 - F.col("place")).alias("place"), F.regexp_replace(F.trim("raw"), "^- ", "").alias("content"))
    return cv.assembled(docs, "p_brand", "text", plan).select("p_brand", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def cv_plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that puts every role's longer bullet in place of the shorter one, and asks for a third."""
    docs = _brand_cvs(spark, sf_dir)
    lines = cv._slots(docs, "p_brand", "text").filter("place IS NOT NULL")
    plan = lines.select("p_brand", "role_no", (F.col("place") + 1).alias("place"), F.concat(F.regexp_replace(F.trim("raw"), "^- ", ""), F.lit("!!")).alias("content"))
    return cv.plan_problems(docs, "p_brand", "text", plan).groupBy("p_brand", "place", "problem").agg(F.count("*").alias("n"))


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.profiles(table(spark, sf_dir, "documents"))


def profile_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = store.shared_table(languages.profiles(docs), spark)
    # a text that is too short has no language, so passes without being looked at again
    found = languages.detected(docs, "doc_id", learned)
    return found.select("doc_id", "language", F.coalesce(F.col("language").isin("en", "es", "it"), F.lit(True)).alias("passes"))


_STRONG, _SENIOR = ["STEEL", "BRASS"], ["LARGE", "ECONOMY"]
_ORDERS = {1: [TitleClass("ai_city", "ai", False), TitleClass("ai_country", "ai", True), TitleClass("rest", "other")], 2: [TitleClass("ai", "ai"), TitleClass("rest_city", "other", False), TitleClass("rest_country", "other", True)]}
_DEFAULT = [TitleClass("ai_country", "ai", True), TitleClass("ai_city", "ai", False), TitleClass("rest", "other")]
_VALUES = {"ai_city": 0, "ai": 1, "ai_country": 2, "rest_city": 3, "rest": 5}


def title_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as postings: the type is the title, the manufacturer's digit the tier, an even size a place that is only a country."""
    p = table(spark, sf_dir, "part")
    tier, country = F.col("p_size") % 4, F.col("p_size") % 2 == 0
    kind = queueing.title_kind(F.col("p_type"), _STRONG, _SENIOR)
    found = p.select("p_partkey", tier.alias("tier"), kind.alias("kind"), country.alias("country_only"))
    found = found.withColumn("rank", queueing.stored_rank(F.col("tier"), F.col("kind"), F.col("country_only"), _ORDERS, _DEFAULT))
    return found.withColumn("value_rank", queueing.value_of_rank(F.col("tier"), F.col("rank"), _ORDERS, _DEFAULT, _VALUES))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "refused").alias("refused"), F.when(F.dayofweek(F.first(F.to_date("at"))) != 1, F.count_if(F.col("outcome") == "error")).alias("errors"))


def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.as_text(_days(spark, sf_dir), ["requests", "refused", "errors"])


def comparison_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.comparison_text(trend.before_after(_days(spark, sf_dir), "2024-01-27", ["requests", "refused", "errors"]))


def outcome_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over a partitioned and ordered table, from SQL."""
    register.register_all(spark)
    request_log(spark, sf_dir).select("event_id", "at", "host", "outcome").createOrReplaceTempView("mr_request_log")
    return spark.sql("SELECT host, outcome, n, began, ended FROM mr_runs(TABLE(SELECT * FROM mr_request_log) PARTITION BY host ORDER BY (at, event_id), 'host')")


def refusal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and rates by functions written in SQL, over aggregates with partial sums."""
    register.register_all(spark)
    request_log(spark, sf_dir).createOrReplaceTempView("mr_request_log_all")
    return spark.sql("""
        SELECT source, part, round(mr_wilson_upper(hits, n), 9) AS upper, round(mr_rate(hits, nothing), 9) AS none, round(mr_rate(hits, n), 9) AS rate
        FROM (SELECT source, host % 10 AS part, count_if(outcome = 'refused') AS hits, count(*) AS n, count_if(digit > 20) AS nothing FROM mr_request_log_all GROUP BY source, host % 10)""")


def sql_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles' and companies' keys by functions written in SQL."""
    register.register_all(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("mr_suppliers")
    return spark.sql("SELECT s_suppkey, mr_title_key(s_name) AS title_key, mr_company_key(concat(s_name, ' Café S.p.A.')) AS company_key FROM mr_suppliers")


def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", delivery.manifest({"id": F.col("doc_id"), "lang": F.col("lang")}, {"text": F.coalesce("text", F.lit("")), "source": F.col("source")}).alias("manifest"))


def retry_after_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as HTTP dates, sizes as seconds, and words that are neither."""
    o = table(spark, sf_dir, "orders")
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("o_orderstatus") == "F", date).when(F.col("o_orderstatus") == "O", F.floor(F.col("o_totalprice") / 1000).cast("string")).otherwise("soon")
    return o.select("o_orderkey", timeutil.retry_after(header, at("1995-06-01 00:00:00")).alias("wait_s"))


def turn_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns in a row each kind may have, by its share of the requests, and the speeds of spacings made of its counts."""
    log = request_log(spark, sf_dir)
    share = log.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "ok").alias("ok"))
    spacings = F.array(F.lit(75.0), F.lit(75.0) / 2, F.lit(75.0) * 100 / F.col("ok"), F.lit(10.0))
    return share.select("source", stats.run_cap(F.col("ok") / F.col("n")).alias("turns"), F.transform(stats.speeds(spacings), lambda x: F.round(x, 9)).alias("speeds"), stats.hold_level(spacings).alias("hold"))


def ignored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as news about orders: those of orders that are open come in, the first of each, and known ones stay as they are."""
    state = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit(0).cast("int").alias("line"))
    news = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("line"))
    return store.ignore_upsert(state, news, ["id"], ["line"])


def patched_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties with an entry more and without one, as entries in order."""
    e = table(spark, sf_dir, "events")
    base = F.map_filter(F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string")), lambda _, v: v.isNotNull())
    patch = F.when(F.col("value") > 50, F.create_map(F.lit("k"), F.lit("big"), F.lit("note"), F.lit("x")))
    out = store.patched(base, patch, ["user"])
    return e.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda x: F.concat_ws("=", x["key"], x["value"]))), ";").alias("entries"))


def tier_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each tier's turn last was and how many picks it had, from a state and the picks since."""
    t = tiered(spark, sf_dir).filter("tier IS NOT NULL")
    state = t.filter(F.col("first_seen") < at("1995-01-01 00:00:00")).groupBy("tier").agg(F.max("first_seen").alias("turn_at"), F.count("*").alias("picks_done"))
    return store.turn_clocks(state, t.filter(F.col("first_seen") >= at("1995-01-01 00:00:00")).select("tier", F.col("first_seen").alias("at")))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey", "left")  # 25 nations


def cheap_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as postings in their nation: the market is the title, those with a balance are described, those with a large one were seen before."""
    c = _customers(spark, sf_dir)
    i, url = F.col("c_custkey"), F.concat(F.lit("https://x.org/"), F.col("c_custkey").cast("string"))
    language = F.when(i % 3 == 0, "en").when(i % 3 == 1, "de")
    ready = c.select(i.alias("id"), url.alias("url"), F.concat("c_mktsegment", F.lit(" Baker")).alias("title"), F.concat(F.lit("Plant, "), F.initcap("n_name")).alias("location"), (i % 4 + 1).cast("int").alias("tier_hint"), language.alias("language"), (F.col("c_acctbal") > 0).alias("described"))
    seen = c.filter("c_acctbal > 9000").select(F.md5(F.concat(F.lit("https://x.org/"), F.col("c_custkey").cast("string"))).alias("link_hash"))
    return lifecycle.cheap_checks(ready, seen, ["Household", "automobile"], ["en", "es", "it"]).select("id", "stage", "stage_reason", "tier")


def advice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line shown for a customer's nation as the place that a reason names."""
    c = _customers(spark, sf_dir)
    i = F.col("c_custkey")
    verdict = F.when(i % 4 == 0, "confirmed").when(i % 4 == 1, "unconfirmed").otherwise("advised")
    advice = F.when(i % 7 == 0, F.concat(F.lit("  ask "), "c_mktsegment", F.lit(" "))).when(i % 7 == 1, "  ")
    named = geo.countries_in(F.concat(F.lit("The team is based in "), F.initcap("n_name"), F.lit(".")))
    return c.select("c_custkey", rules.advice_line(verdict, advice, named).alias("advice"), rules.section_label(verdict).alias("section"))


QUERIES = {
    f.__name__: f
    for f in (
        cheap_decisions, advice_lines, running_gates, degraded_runs, shared_failover, degraded_stages, rejected_audit, message_progress, cv_assembly, cv_plan_problems, language_profiles, profile_languages, title_ranks, trend_lines, comparison_lines, outcome_runs, refusal_bounds, sql_keys,
        package_manifests, retry_after_headers, turn_caps, ignored_rows, patched_properties, tier_clocks,
    )
}

_PROFILES = """
        w AS (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda x: x <> '')) AS word FROM documents WHERE lang IS NOT NULL),
        g AS (SELECT gram, lang, count(*) AS n FROM (SELECT lang, unnest([substr(' ' || word || ' ', i, 3) FOR i IN range(1, length(word) + 1)]) AS gram FROM w) GROUP BY 1, 2),
        t AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM g) AS v FROM g GROUP BY 1),
        profiles AS (SELECT gram, lang, CAST(round(1000 * ln((n + 1) / CAST(total + v AS DOUBLE))) AS BIGINT) AS score FROM g JOIN t USING (lang)
                     UNION ALL SELECT '?', lang, CAST(round(1000 * ln(1 / CAST(total + v AS DOUBLE))) AS BIGINT) FROM t)"""
_CVS = """
        e AS (SELECT p_brand, p_type || ' ' || p_partkey AS role, p_name, '**' || p_type || ' ' || p_partkey || '**' || chr(10) || '  - Built ' || p_name || ' ' || chr(10) || '- sold 3 ' || p_name AS entry FROM part)"""
_HAS = lambda ws: "regexp_matches(p_type, '\\b(" + "|".join(ws) + ")\\b')"
_DAYS = """
        days AS (SELECT CAST(seen_at AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE outcome = 'refused') AS refused,
                        CASE WHEN dayofweek(CAST(min(seen_at) AS DATE)) <> 0 THEN count(*) FILTER (WHERE outcome = 'error') END AS errors FROM log GROUP BY 1)"""
_TWO = lambda c: f"CAST(CAST({c} AS DECIMAL(20, 2)) AS VARCHAR)"
_PART = lambda m: f"'{m} ' || coalesce({_TWO(m)}, '?') || ' (' || coalesce(CASE WHEN {m} - lag({m}) OVER w >= 0 THEN '+' ELSE '' END || {_TWO(f'{m} - lag({m}) OVER w')}, '?') || ')'"

_FAILOVER = """
        j AS (SELECT id, tier, score, year(first_seen) AS year, first_seen FROM jobs WHERE tier IS NOT NULL),
        p1 AS (SELECT id, 'first' AS provider FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY first_seen, id) AS k FROM j) WHERE k <= 200 AND score <= 7),
        p2 AS (SELECT id, 'second' AS provider FROM j WHERE tier <> 3 AND id NOT IN (SELECT id FROM p1)),
        p3 AS (SELECT id, 'third' AS provider FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY first_seen, id) AS k FROM j WHERE id NOT IN (SELECT id FROM p1) AND id NOT IN (SELECT id FROM p2)) WHERE k <= 20 AND score = 9),
        told AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""

ORACLES = {
    "cheap_decisions": """
        WITH c AS (SELECT c_custkey AS id, c_acctbal, c_mktsegment AS m, CASE WHEN n_name IN ('FRANCE', 'GERMANY', 'ROMANIA') THEN 3 WHEN n_name = 'UNITED KINGDOM' THEN 4 WHEN n_name IN ('UNITED STATES', 'CANADA', 'INDIA', 'RUSSIA') THEN NULL ELSE c_custkey % 4 + 1 END AS tier
                   FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
        r AS (SELECT *, CASE WHEN c_acctbal > 9000 THEN 'seen_before_cutover' WHEN tier IS NULL THEN 'out_of_scope' WHEN m = 'HOUSEHOLD' THEN 'title_prefilter:Household' WHEN m = 'AUTOMOBILE' THEN 'title_prefilter:automobile'
                             WHEN c_acctbal > 0 AND id % 3 = 1 THEN 'language:de' ELSE '' END AS reason FROM c)
        SELECT id, CASE WHEN reason <> '' THEN 'filtered_out' WHEN c_acctbal > 0 THEN 'described' ELSE 'seen' END AS stage, reason AS stage_reason, CAST(tier AS INTEGER) AS tier FROM r""",
    "advice_lines": """
        WITH c AS (SELECT c_custkey, c_mktsegment AS m, CASE WHEN n_name = 'UNITED KINGDOM' THEN 'the UK' WHEN n_name = 'UNITED STATES' THEN 'the US'
                              WHEN n_name IN ('FRANCE', 'GERMANY', 'ROMANIA', 'CANADA', 'INDIA', 'BRAZIL', 'JAPAN', 'CHINA') THEN upper(n_name[1]) || lower(n_name[2:]) END AS place FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
        SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN '' WHEN c_custkey % 7 = 0 THEN 'ask ' || m WHEN place IS NOT NULL THEN 'remote, limited to ' || place || ' - check eligibility' ELSE 'remote, eligibility to check' END AS advice,
               CASE c_custkey % 4 WHEN 0 THEN 'Confirmed full-remote' WHEN 1 THEN 'Work mode not stated' ELSE 'Remote, eligibility to check' END AS section FROM c""",
    "shared_failover": f"WITH {JOBS}, {_FAILOVER} SELECT year, provider, count(*) AS n, CAST(sum(score) AS BIGINT) AS points, max(first_seen) AS last FROM j JOIN told USING (id) GROUP BY 1, 2",
    "degraded_stages": f"""
        WITH {JOBS}, {_FAILOVER}, b AS (SELECT year, id // 4 AS batch, count(provider) AS n FROM j LEFT JOIN told USING (id) GROUP BY 1, 2)
        SELECT year, count(*) AS batches, count(*) FILTER (WHERE n = 0) AS failed_batches, CAST(count(*) FILTER (WHERE n = 0) AS DOUBLE) / count(*) >= 0.05 AS degraded FROM b GROUP BY 1""",
    "running_gates": f"""
        WITH {CALL_LOG}, d AS (SELECT *, CAST(seen_at AS DATE) AS day FROM calls),
        b AS (SELECT event_id, stage, tokens, count(*) OVER u - 1 AS requests_before, count(*) FILTER (WHERE stage = 'click') OVER u - CASE WHEN stage = 'click' THEN 1 ELSE 0 END AS stage_before,
                     CAST(sum(tokens) OVER u AS BIGINT) - tokens AS tokens_before, CAST(sum(tokens) OVER r AS BIGINT) - tokens AS window_before FROM d
              WINDOW u AS (PARTITION BY day ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY day ORDER BY epoch_us(seen_at) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
        SELECT event_id, requests_before, stage_before, tokens_before, window_before,
               requests_before < 300 AND tokens_before < 100000 AND window_before + tokens <= 8000 AND (stage <> 'click' OR stage_before < 120) AS may_call FROM b""",
    "degraded_runs": f"""
        WITH {CALL_LOG}, b AS (SELECT CAST(seen_at AS DATE) AS day, stage, host, count(*) FILTER (WHERE outcome = 'ok') AS n FROM calls GROUP BY 1, 2, 3)
        SELECT day, count(*) AS batches, count(*) FILTER (WHERE n = 0) AS failed_batches, CAST(count(*) FILTER (WHERE n = 0) AS DOUBLE) / count(*) >= 0.25 AS degraded FROM b GROUP BY 1""",
    "rejected_audit": f"""
        WITH {JOBS}, r AS (SELECT jobs.*, o_orderpriority AS company FROM jobs JOIN orders ON id = o_orderkey WHERE remote_verdict = 'rejected' AND tier <> 5),
        t AS (SELECT DISTINCT tier FROM jobs WHERE tier IS NOT NULL)
        SELECT '{DAY}/tier' || tier || '/rejected.md' AS path, CAST(-2 AS BIGINT) AS n, '# Rejected by remote verification - {DAY} (tier ' || tier || ')' || chr(10) AS text FROM t
        UNION ALL SELECT '{DAY}/tier' || tier || '/rejected.md', -1, chr(10) || 'None. Every offer was confirmed, advised or left with its work mode unstated.' || chr(10) FROM t WHERE tier NOT IN (SELECT tier FROM r WHERE tier IS NOT NULL)
        UNION ALL SELECT '{DAY}/tier' || tier || '/rejected.md', id, chr(10) || '- **Job ' || id || ' - ' || company || '** · ' || coalesce(stage, '') || ' · [link]()' || chr(10) || '  ' || coalesce(stage_reason, '') || chr(10) FROM r""",
    "message_progress": """
        WITH r AS (SELECT conv_id, turn AS part, length(coalesce(text, '')) AS n, CASE length(coalesce(text, '')) % 10 WHEN 7 THEN 'refused' WHEN 3 THEN 'down' ELSE 'ok' END AS outcome FROM conversations),
        s AS (SELECT conv_id, CASE WHEN min(n) FILTER (WHERE part = 0) % 2 = 0 THEN 1 ELSE 0 END AS first, max(part) + 1 AS parts FROM r GROUP BY 1),
        d AS (SELECT conv_id, min(part) AS down FROM r JOIN s USING (conv_id) WHERE part >= first AND outcome = 'down' GROUP BY 1),
        x AS (SELECT r.conv_id, r.part, r.outcome, r.n, s.first, s.parts, d.down, part >= first AND (down IS NULL OR part < down) AS sent FROM r JOIN s ON r.conv_id = s.conv_id LEFT JOIN d ON r.conv_id = d.conv_id),
        y AS (SELECT conv_id, max(parts) AS parts, coalesce(max(down), max(parts)) AS next, max(first) + count(*) FILTER (WHERE sent AND outcome = 'ok') AS accepted,
                     arg_min(400 + n % 4, part) FILTER (WHERE sent AND outcome = 'refused') AS refused_status FROM x GROUP BY 1)
        SELECT conv_id, CAST(parts AS BIGINT) AS parts, CAST(next AS BIGINT) AS next, CAST(accepted AS BIGINT) AS accepted, CAST(refused_status AS INTEGER) AS refused_status,
               CASE WHEN next <> parts THEN 'due' WHEN refused_status IS NULL THEN 'sent' ELSE 'refused' END AS state FROM y""",
    "cv_assembly": f"""
        WITH {_CVS}, s AS (SELECT p_brand, string_agg('**' || role || '**' || chr(10) || '  - sold 3 ' || p_name || ' ' || chr(10) || '- Built ' || p_name, chr(10) || chr(10) ORDER BY encode(entry)) AS body FROM e GROUP BY 1),
        f AS (SELECT p_brand, '# Name' || chr(13) || chr(10) || chr(10) || '## Summary' || chr(10) || 'Short.' || chr(10) || '- a point' || chr(10) || chr(10) || '## Experience' || chr(10) || body || chr(10) || chr(10)
                     || '## Skills' || chr(10) || '**Tools:** all' || chr(10) || '- lp.one :: proof' || chr(10) AS t FROM s)
        SELECT p_brand, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS text_sha256 FROM f""",
    "cv_plan_problems": """
        SELECT p_brand, 2 AS place, 'too long' AS problem, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT p_brand, 3, 'no such bullet', count(*) FROM part GROUP BY 1""",
    "language_profiles": f"WITH {_PROFILES} SELECT gram, lang, score FROM profiles",
    "profile_languages": f"""
        WITH {_PROFILES}, u AS (SELECT lang, score AS unseen FROM profiles WHERE gram = '?'),
        d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM documents WHERE length(trim(text, ' ')) >= 40),
        own AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest([substr(' ' || word || ' ', i, 3) FOR i IN range(1, length(word) + 1)]) AS gram FROM d) GROUP BY 1, 2),
        s AS (SELECT doc_id, u.lang, sum(n * coalesce(p.score, unseen)) AS score FROM own CROSS JOIN u LEFT JOIN profiles p ON p.gram = own.gram AND p.lang = u.lang GROUP BY 1, 2),
        b AS (SELECT doc_id, lang AS language FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
        SELECT doc_id, language, coalesce(length(trim(text, ' ')) < 40 OR language IS NULL OR language IN ('en', 'es', 'it'), true) AS passes FROM documents LEFT JOIN b USING (doc_id)""",
    "title_ranks": f"""
        WITH p AS (SELECT p_partkey, p_size % 4 AS tier, CASE WHEN {_HAS(_STRONG)} AND NOT {_HAS(_SENIOR)} THEN 'ai' ELSE 'other' END AS kind, p_size % 2 = 0 AS country_only FROM part),
        c AS (SELECT *, CASE WHEN tier = 1 THEN CASE WHEN kind = 'other' THEN 2 WHEN country_only THEN 1 ELSE 0 END WHEN tier = 2 THEN CASE WHEN kind = 'ai' THEN 0 WHEN country_only THEN 2 ELSE 1 END
                             ELSE CASE WHEN kind = 'other' THEN 2 WHEN country_only THEN 0 ELSE 1 END END AS rank FROM p)
        SELECT *, CASE WHEN tier = 1 THEN [0, 2, 5][rank + 1] WHEN tier = 2 THEN [1, 3, 99][rank + 1] ELSE [2, 0, 5][rank + 1] END AS value_rank FROM c""",
    "trend_lines": f"""
        WITH {REQUEST_LOG}, {_DAYS} SELECT day, CAST(day AS VARCHAR) || '  ' || {" || ', ' || ".join(_PART(m) for m in ("requests", "refused", "errors"))} AS line FROM days WINDOW w AS (ORDER BY day)""",
    "comparison_lines": f"""
        WITH {REQUEST_LOG}, {_DAYS}, u AS (SELECT day, unnest(['requests', 'refused', 'errors']) AS metric, unnest([requests, refused, errors]) AS v FROM days),
        s AS (SELECT metric, count(*) FILTER (WHERE day < DATE '2024-01-27') AS a_n, count(*) FILTER (WHERE day >= DATE '2024-01-27') AS b_n,
                     CAST(sum(v) FILTER (WHERE day < DATE '2024-01-27') AS DOUBLE) / count(*) FILTER (WHERE day < DATE '2024-01-27') AS a, CAST(sum(v) FILTER (WHERE day >= DATE '2024-01-27') AS DOUBLE) / count(*) FILTER (WHERE day >= DATE '2024-01-27') AS b FROM u GROUP BY 1),
        r AS (SELECT metric, a_n, b_n, round(a, 6) AS a, round(b, 6) AS b, round((b - a) * 100 / a, 6) AS c FROM s)
        SELECT metric, metric || ': ' || coalesce({_TWO("a")}, '?') || ' before, ' || coalesce({_TWO("b")}, '?') || ' after (' || coalesce(CASE WHEN c >= 0 THEN '+' ELSE '' END || CAST(CAST(c AS DECIMAL(20, 1)) AS VARCHAR), '?') || ' %)'
               || CASE WHEN least(a_n, b_n) < 5 THEN ', indicative only: ' || a_n || ' and ' || b_n || ' days' ELSE '' END AS line FROM r""",
    "outcome_runs": f"""
        WITH {REQUEST_LOG}, m AS (SELECT host, outcome, seen_at, event_id, row_number() OVER (PARTITION BY host ORDER BY seen_at, event_id) - row_number() OVER (PARTITION BY host, outcome ORDER BY seen_at, event_id) AS island FROM log)
        SELECT host, outcome, count(*) AS n, min(seen_at) AS began, max(seen_at) AS ended FROM m GROUP BY host, outcome, island""",
    "refusal_bounds": f"""
        WITH {REQUEST_LOG}, c AS (SELECT source, host % 10 AS part, count(*) FILTER (WHERE outcome = 'refused') AS hits, CAST(count(*) AS DOUBLE) AS n FROM log GROUP BY 1, 2), p AS (SELECT *, hits / n AS p, CAST(1.96 AS DOUBLE) AS z FROM c)
        SELECT source, part, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS upper, CAST(NULL AS DOUBLE) AS none, round(p, 9) AS rate FROM p""",
    "sql_keys": "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || ' cafe' AS company_key FROM supplier",
    "package_manifests": """
        SELECT doc_id, '{' || CASE WHEN doc_id IS NULL THEN '' ELSE '"id":' || doc_id || ',' END || CASE WHEN lang IS NULL THEN '' ELSE '"lang":"' || lang || '",' END || '"text_sha256":"' || sha256(coalesce(text, '')) || '"'
               || CASE WHEN source IS NULL THEN '' ELSE ',"source_sha256":"' || sha256(source) || '"' END || '}' AS manifest FROM documents""",
    "retry_after_headers": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN greatest(0, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1995-06-01 00:00:00') AS DOUBLE)) WHEN 'O' THEN CAST(floor(o_totalprice / 1000) AS DOUBLE) ELSE 0 END AS wait_s FROM orders""",
    "turn_caps": f"""
        WITH {REQUEST_LOG}, s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE outcome = 'ok') AS ok FROM log GROUP BY 1), x AS (SELECT source, CAST(ok AS DOUBLE) / n AS p, ok FROM s)
        SELECT source, CAST(greatest(1, round_even(p / (1 - p), 0)) AS INTEGER) AS turns, [1.0, 2.0, round(ok / CAST(100 AS DOUBLE), 9), 7.5] :: DOUBLE[] AS speeds, CASE WHEN ok / CAST(100 AS DOUBLE) <= 3 THEN 3 ELSE 2 END AS hold FROM x""",
    "ignored_rows": "SELECT o_orderkey AS id, 0 AS line FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, min(l_linenumber) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "patched_properties": """
        SELECT event_id, CASE WHEN value > 50 THEN 'k=big;note=x' ELSE coalesce('k=' || json_extract_string(props, '$.k'), '') END || ';type=' || event_type AS entries FROM events""",
    "tier_clocks": f"WITH {TIERED} SELECT tier, max(first_seen) AS turn_at, count(*) AS picks_done FROM tiered WHERE tier IS NOT NULL GROUP BY 1",
}
