"""Queries over report blocks, claims, queues, labels and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.timeutil import at, clamp_cadence, delivery_due, overdue, posted_window_days, pulled_in, started_before_today
from millrace.operators import calls, cv, health, labels, lifecycle, messages, model_stage, queueing, reports, requests, resolve, rules, trend
from millrace.plans.delivery_queries import JOBS, jobs
from millrace.plans.order_queries import TIERED, tiered
from millrace.plans.tables import CALL_LOG, REQUEST_LOG, call_log, request_log, table
from millrace.sources import feeds, store

NOW = "1998-06-01 00:00:00"
THRESHOLDS = {1: 8, 2: 7, 3: 6}


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 5).alias("source"), F.col("l_shipdate").alias("seen_at"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies as slices of their market, due at an hour of three days before now."""
    due = at("1998-05-30 00:00:00") + F.make_dt_interval(hours=(F.col("c_custkey") % 90).cast("int"))
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("slice"), F.col("c_mktsegment").alias("source"), (F.col("c_nationkey") % 5 + 1).alias("tier"), (F.col("c_acctbal") > 0).alias("active"), due.alias("due_at"), (due - F.expr("INTERVAL 30 HOURS")).alias("walked_at"))


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    stop = F.when(F.col("o_orderstatus") == "F", "end_of_results").when(F.col("o_orderstatus") == "O", "known_page").otherwise("cap_hit")
    return o.select(F.col("o_custkey").alias("slice"), F.col("o_orderpriority").alias("area"), F.col("o_orderdate").alias("walked_at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"), F.floor(F.col("o_totalprice") / 20_000).cast("long").alias("pages"), stop.alias("stop_reason"))


def day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).withColumn("delivered_at", F.when(F.col("stage") == "delivered", F.col("first_seen")))
    packages = jobs(spark, sf_dir).filter("shown_at IS NOT NULL").select("id", F.col("shown_at").alias("packaged_at"))
    usage = call_log(spark, sf_dir).groupBy(F.col("stage").alias("provider")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    beats = tiered(spark, sf_dir).filter(F.col("first_seen") <= at(NOW)).select(F.concat_ws("-", "status", "class").alias("service"), F.col("first_seen").alias("beat_at"))
    return reports.day_summary(j, _sightings(spark, sf_dir), packages, usage, beats, THRESHOLDS, at(NOW), 36 * 3600)


def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).withColumns({"stage_changed_at": F.col("first_seen"), "cls": F.when(F.col("score") < 9, F.col("score") % 3)})
    return reports.status_view(j, _slices(spark, sf_dir), F.col("stage") == "seen", at(NOW))


def day_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).filter("tier IS NOT NULL")
    runs = t.groupBy("tier").agg(F.max("class").alias("attempts"), F.when(F.min("class") == 1, "ok").otherwise("failed").alias("status"), F.count("*").alias("fetched"), F.count_if(F.col("status") == "F").alias("scored"), F.count_if((F.col("status") == "F") & (F.col("price") >= 300_000)).alias("strong"))
    log = call_log(spark, sf_dir).withColumns({"tier": F.col("host") % 4 + 1, "model": F.concat(F.lit("vendor/"), "model", F.lit(":free"))})
    return reports.day_report(runs, log)


def day_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.as_lines(day_report(spark, sf_dir).filter("section = 'tier'"))


def run_rule_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).groupBy("host").agg(F.count("*").alias("fetched"), F.count_if(F.col("status") == 429).alias("search_429"), F.count_if(F.col("status") == 403).alias("description_429"), F.count_if(F.col("status") == 503).alias("deferred"), F.count_if(F.col("digit") >= 8).alias("other_answers"), F.count_if(F.col("digit") > 2).alias("answered"), F.count_if(F.col("digit") == 3).alias("cut_short"))
    h = F.col("host")
    runs = log.withColumns(
        {
            "status": F.when(h % 10 == 0, None).when(h % 10 == 1, "running").when(h % 10 == 2, "failed").otherwise("ok"), "later_started": h % 20 == 1, "attempts": (h % 3).cast("int"), "degraded": h % 7 == 0, "batches_failed": (h % 5).cast("int"),
            "telemetry_ok": h % 11 != 0, "given_up": F.when(h % 13 == 0, 1), "limit_used": F.col("fetched"), "limit_per_day": F.lit(60),
        }
    )
    return trend.warnings(runs, ["host"], reports.run_rules(most_429=12, most_deferred=0.15, other_share=0.3))


def fair_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.fair_claim(_slices(spark, sf_dir), _walks(spark, sf_dir).select("slice", "walked_at"), at(NOW), 25).select("slice", "tier", "due_at", "served_at")


def class_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tiered(spark, sf_dir).withColumn("cls", F.when(F.col("class") <= 3, F.col("class")))
    return queueing.backfill(p, F.col("cls").isNull() & (F.col("status") == "O"), F.col("class") + F.lit(10), "cls", ["first_seen", "id"], 200).select("id", "cls", "first_seen")


def verdict_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select(F.when(F.col("tier") != 4, F.concat(F.lit("p"), F.col("tier").cast("string"))).alias("provider"), *((F.col("remote_verdict") == v).cast("int").alias(v) for v in ("confirmed", "rejected", "not_stated")))
    return calls.verdict_mix(j, "provider", ["confirmed", "rejected", "not_stated"])


def area_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pages_per_area(_walks(spark, sf_dir), at(NOW), 24 * 14)


def late_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.late_slices(_slices(spark, sf_dir), at(NOW), 3600).select("slice", "late_s")


def walk_stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stop_reasons(_walks(spark, sf_dir), at(NOW), 24 * 14)


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.answers_by_model(call_log(spark, sf_dir), "stage")


def last_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.attempts(request_log(spark, sf_dir).withColumn("attempt", F.col("event_id")), ["host"], ["source", "outcome"])


def call_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = call_log(spark, sf_dir)
    per_day = log.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("stage") == "click").alias("stage_requests"))
    return calls.may_call(per_day, 40, 0.4)


def waiting_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).withColumns({"description_status": F.when(F.col("score") % 2 == 0, "pending").when(F.col("score") % 3 == 0, "rate_limited").otherwise("ok"), "next_attempt_at": F.col("first_seen") + F.expr("INTERVAL 100 DAYS")})
    return j.filter(lifecycle.waiting(at(NOW))).groupBy("tier", "description_status").agg(F.count("*").alias("n"))


def undone_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    back = lifecycle.undo(j, "language:2", "seen")
    return back.groupBy("stage", "stage_reason").agg(F.count("*").alias("n"))


def reason_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.reason_counts(jobs(spark, sf_dir)).withColumnRenamed("count", "n")


def cheap_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).withColumn("description", F.when(F.col("score") > 5, "text").when(F.col("score") > 3, " \n "))
    return lifecycle.cheap_selection(j, ["first_seen", "id"], 100).select("id", "first_seen")


def deferred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = tiered(spark, sf_dir).withColumn("next_attempt_at", F.col("first_seen"))
    return lifecycle.defer(j, F.col("status") == "O", F.col("class"), at(NOW), 1800, 43_200).select("id", "attempts", "next_attempt_at")


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).select(F.col("host").alias("id"), "at", F.col("event_id").alias("seq"), F.col("source").alias("stage"), F.col("outcome").alias("reason"))
    return lifecycle.transitions(log).select("id", "stage", "reason")


def description_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    description = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), "p_name", F.lit(" at "), "p_brand")).when(F.col("p_size") % 4 == 1, "  ").otherwise(F.col("p_name"))
    status = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, "partial").when(F.col("p_size") % 5 == 2, "error").otherwise("ok")
    stands_in = text.is_title_only(description, F.col("p_name"), F.col("p_brand"))
    return p.groupBy(text.description_status(status, description, stands_in).alias("status"), stands_in.alias("stands_in")).agg(F.count("*").alias("n"))


def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.when(F.col("p_size") % 9 != 0, F.col("p_partkey") * F.col("p_size"))
    start, end = at("2024-01-01 00:00:00"), at("2024-01-01 00:00:00") + F.make_dt_interval(secs=(F.col("p_partkey") * 7).cast("double"))
    return p.select(
        "p_partkey", text.tokens_text(n).alias("tokens"), text.age_text(F.col("p_size") * 1000).alias("age"), text.duration_text(start, F.when(F.col("p_size") % 7 != 0, end)).alias("duration"),
        text.short_model(F.concat(F.lit("vendor/"), "p_brand", F.when(F.col("p_size") % 2 == 0, ":free").otherwise(""))).alias("model"), text.escape_html(F.concat(F.lit("<b>"), "p_name", F.lit("</b> & co"))).alias("html"),
    )


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each description within its share of a batch's budget, an excerpt at the end of those that don't fit."""
    d = table(spark, sf_dir, "documents").withColumns({"batch": (F.col("doc_id") % 12 + 1).cast("int"), "body": F.coalesce("text", F.lit(""))})
    cut = text.prompt_text(F.col("body"), F.when(F.col("doc_id") % 2 == 0, "Remote or not?").otherwise(""), text.description_budget(F.col("batch")))
    return d.select("doc_id", F.length(cut).alias("chars"), F.md5(cut.cast("binary")).alias("md5"))


def link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    number = (F.col("page_id") + 10_000).cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://de.linkedin.com/jobs/view/some-role-"), number)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://linkedin.cn/x/"), number, F.lit("/"))).otherwise(F.col("url"))
    secret = F.concat(F.lit("postgres://user:s3cret"), F.col("page_id").cast("string"), F.lit("@host/db"))
    return p.select("page_id", text.legacy_key(text.board_job_id(url), url).alias("legacy_key"), text.fingerprint(url, 12).alias("version"), text.redact(secret).alias("shown"), text.note_number(F.concat(F.lit("note_"), F.col("page_id").cast("string"), F.lit(".md"))).alias("note"))


def quotes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's name, written otherwise, stands in its note."""
    p = table(spark, sf_dir, "part")
    quote = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise("no")
    return p.groupBy(text.quote_found(quote, F.concat(F.lit("Note: "), "p_name", F.lit("!"))).alias("found")).agg(F.count("*").alias("n"))


def labels_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("posting_key")
    first = l.select(key, F.lit("golden").alias("label"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("job_id"), at("2024-01-01 00:00:00").alias("labeled_at"), F.lit(1).alias("seq"))
    second = l.filter("toxic = 1").select(key, F.lit("not_for_me").alias("label"), F.lit(None).cast("long").alias("job_id"), at("2024-01-02 00:00:00").alias("labeled_at"), F.lit(2).alias("seq"))
    return labels.current_labels(first.unionByName(second)).select("posting_key", "label", "job_id")


def label_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.missing_share(labels_in_force(spark, sf_dir))


def rekeyed_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings by the surviving entity, where each company's postings are merged into its first."""
    roots = tiered(spark, sf_dir).groupBy("company").agg(F.min("id").alias("root")).join(tiered(spark, sf_dir).select("company", "id"), "company").select("id", "root")
    return resolve.rekey(_sightings(spark, sf_dir), roots).groupBy("id").agg(F.count("*").alias("sightings"))


def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after a run, its expired rows left out."""
    t = tiered(spark, sf_dir).withColumn("link", F.concat(F.lit("l"), F.col("id").cast("string")))
    before = t.filter("status <> 'F'").select("link", F.col("first_seen").alias("queued_at"))
    failed = t.filter("status <> 'P'").select("link", F.when(F.col("class") % 2 == 0, "throttled").otherwise("scoring").alias("kind"))
    queue = store.deferred_queue(before, failed, at(NOW))
    return store.live_deferred(queue, at(NOW), 60, 30, "Europe/Rome").select("link", "kind", "queued_at")


def todays_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).withColumn("link", F.concat(F.lit("l"), F.col("id").cast("string")))
    fresh = t.filter("status <> 'P'").select("link", F.when(F.col("class") > 2, F.concat(F.lit("new "), F.col("id").cast("string"))).otherwise("").alias("description"))
    queued = t.filter("status <> 'F'").select("link", F.when(F.col("class") > 1, F.concat(F.lit("old "), F.col("id").cast("string"))).otherwise("").alias("description"))
    return store.todays_copy_wins(fresh, queued)


def clamped_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _slices(spark, sf_dir)
    hours = clamp_cadence((F.col("slice") % 70).cast("int"), 12, 48)
    stop = F.when(F.col("tier") == 1, "error").when(F.col("tier") == 2, "cap_hit").otherwise("known_page")
    return w.select("slice", hours.alias("hours"), pulled_in(F.col("due_at"), F.when(F.col("active"), F.col("walked_at")), hours, stop).alias("due_at"))


def due_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).filter("status = 'O'").groupBy("company").agg(F.min("first_seen").alias("oldest"), F.max("first_seen").alias("latest"))
    now = F.col("latest") + F.expr("INTERVAL 200 HOURS")
    return t.select("company", overdue(F.col("oldest"), now, 24 * 60).alias("is_overdue"), delivery_due(now, "Europe/Rome", 8).alias("deliver"), posted_window_days(F.when(F.col("company") % 5 != 0, F.col("latest")), now).alias("days"), started_before_today(F.col("latest"), now, "Europe/Rome").alias("is_over"))


def verdict_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("remote_verdict")
    j = jobs(spark, sf_dir).withColumn("remote_verdict", F.when(F.col("score") == 2, "unconfirmed").otherwise(v))
    return j.groupBy(rules.folded(v).alias("verdict"), rules.may_alert(v, F.col("tier") == 1).alias("alerts"), rules.may_package(v).alias("packages"), rules.section_label(v).alias("section")).agg(F.count("*").alias("n"))


def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.array(*map(F.lit, ("remote", "hybrid", "onsite", "unclear", "other")))
    j = jobs(spark, sf_dir).withColumns({"mode": F.element_at(modes, (F.col("id") % 5 + 1).cast("int")), "eligibility": F.when(F.col("score") > 6, "eligible").when(F.col("score") > 3, "limited")})
    return j.groupBy(rules.answer_verdict(F.col("mode"), F.col("eligibility"), F.col("score") % 2 == 0).alias("verdict")).agg(F.count("*").alias("n"))


def answers_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of turns and the answers for their places, of which every batch's last is missing."""
    c = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", at("2024-01-01 00:00:00").alias("stage_changed_at"))
    batches = queueing.due_batches(c, 8, at("2024-01-01 00:10:00"), 1800, ["role"], ["conv_id", "turn"])
    answers = batches.filter("place < 7").select("role", "batch", "place", (F.col("batch") * 100 + F.col("place")).alias("answer"))
    return queueing.zip_back(batches, answers, ["role"]).select("role", "conv_id", "turn", "batch", "place", "answer")


def recovered_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals by host and source; an issue that hasn't come up since a moment is over."""
    log = request_log(spark, sf_dir).filter("outcome = 'refused'").select(F.concat_ws("/", F.col("host").cast("string"), "source").alias("key"), "at")
    sent = log.groupBy("key").agg(F.max("at").alias("sent_at"))
    return health.cleared(log.filter(F.col("at") >= at("2024-01-20 00:00:00")), sent)


def archived_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's sightings after the finished postings were copied: it held one stale sighting for each posting before."""
    t = tiered(spark, sf_dir)
    old = t.select("id", F.lit(-1).cast("long").alias("source"))
    now = _sightings(spark, sf_dir).select("id", "source")
    return store.replaced_children(old, now, t.filter("status = 'F'"), "id").groupBy("source").agg(F.count("*").alias("n"))


def first_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each posting once, as its first sighting found it."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("source"))
    return store.first_wins(l, "link", ["place", "source"])


def labels_by_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of notes found by number, where the name agrees; a part of the names belongs to another note."""
    p = table(spark, sf_dir, "part")
    wrong = F.when(F.col("p_size") % 3 == 0, "other_words").otherwise(text.slugify(F.col("p_name")))
    asked = p.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("posting_key"), F.concat(wrong, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("file"))
    return labels.by_note(asked, p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("note_no"), F.col("p_name").alias("title")))


def canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each company the link that stays, of its postings' links to boards and own pages."""
    t = tiered(spark, sf_dir)
    host = F.when(F.col("class") == 1, "careers.example.org").when(F.col("class") == 2, "www.reed.co.uk").when(F.col("class") == 3, "de.indeed.com").when(F.col("class") == 4, "linkedin.com")
    rows = t.withColumn("url", F.concat(F.lit("https://"), host, F.lit("/"), F.col("id").cast("string")))
    return resolve.merged_links(rows, "company", F.struct("first_seen", "id"))


def trailing_share_since_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requests.trailing_share_since(request_log(spark, sf_dir), "host", ["at", "event_id"], F.col("outcome") == "error", 5)
    return found.select("event_id", "in_window", "refused_in")


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    return d.groupBy(model_stage.keyword_score("body", {"river": 4, "house": 3, "and": 2}).alias("score")).agg(F.count("*").alias("n"))


def second_feed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_size") % 6
    item = F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("guid"), F.col("p_name").alias("title"), F.when(k != 5, F.col("p_brand")).alias("companyName"), F.lit("https://x.example.org").alias("applicationLink"),
            F.when(k == 0, F.array(F.lit("Italy"), F.lit("Peru"))).when(k == 1, F.array(F.lit("Peru"))).otherwise(F.array().cast("array<string>")).alias("locationRestrictions"),
            F.when(k == 2, F.array(F.lit(1.0))).when(k == 3, F.array(F.lit(-8.0))).alias("timezoneRestrictions"), (F.lit(1_791_978_330) + F.col("p_partkey")).cast("string").alias("pubDate"),
            F.when(F.col("p_size") % 7 == 0, "2026-01-01T00:00:00Z").alias("expiryDate"), F.lit("<p>Bread</p>").alias("excerpt"),
        )
    )
    cards = feeds.second_feed(p.select(item.alias("json")), F.lit("2026-10-14 00:00:00").cast("timestamp"), ["Italy", "Spain"], [0.0, 1.0])
    return cards.select(F.col("job_id").cast("long").alias("p_partkey"), "title", "company", "location", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "description")


def digest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).filter("status = 'F' AND tier IS NOT NULL")
    digest = messages.digest_sections(t, "tier", [F.desc("price"), "id"], 20, 30, "tier")
    return messages.section_blocks(digest, "tier", F.concat(F.lit("Tier "), F.col("tier").cast("string")), F.concat(F.lit("posting "), F.col("id").cast("string")))


def cv_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of the parts of each brand, taken apart again: bullets and sentences of each role."""
    p = table(spark, sf_dir, "part")
    entry = F.concat(F.lit("**"), "p_type", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("**\n- "), F.when(F.col("p_size") % 2 == 0, "Built ").otherwise("Improve "), "p_name", F.lit("\n- sold 3 "), F.col("p_name"))
    docs = p.groupBy("p_brand").agg(F.concat(F.lit("# Name\n\n## Summary\nShort.\n\n## Experience\n"), F.array_join(F.array_sort(F.collect_list(entry)), "\n"), F.lit("\n\n## Skills\n**Tools:** all\n- lp.one :: proof")).alias("text"))
    lines = cv.cv_lines(docs, "p_brand", "text")
    return lines.groupBy("p_brand", "section", "kind").agg(F.count("*").alias("n"), F.count_if(cv.is_sentence(F.col("content"))).alias("sentences"), F.count_distinct("role").alias("roles"))


QUERIES = {
    f.__name__: f
    for f in (
        archived_children, first_offers, labels_by_note, canonical_links, trailing_share_since_errors, keyword_scores, second_feed_cards, digest_blocks, cv_roles, day_summary, status_view, day_report, day_report_lines, run_rule_warnings, fair_claim, class_backfill, verdict_mix, area_pages, late_slices, walk_stop_reasons, model_answers, last_attempts, call_gates,
        waiting_queue, undone_rule, reason_census, cheap_picks, deferred_rows, stage_log, description_states, text_formats, prompt_texts, link_keys, quotes_found, labels_in_force, label_gaps, rekeyed_sightings,
        retry_queue, todays_copies, clamped_cadence, due_tests, verdict_policies, answer_verdicts, answers_by_place, recovered_alerts,
    )
}

_SLICES = """slices AS (
        SELECT c_custkey AS slice, c_mktsegment AS source, c_nationkey % 5 + 1 AS tier, c_acctbal > 0 AS active, TIMESTAMP '1998-05-30 00:00:00' + to_hours(CAST(c_custkey % 90 AS BIGINT)) AS due_at,
               TIMESTAMP '1998-05-30 00:00:00' + to_hours(CAST(c_custkey % 90 AS BIGINT)) - INTERVAL 30 HOUR AS walked_at FROM customer)"""
_WALKS = """walks AS (
        SELECT o_custkey AS slice, o_orderpriority AS area, o_orderdate AS walked_at, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS tier, CAST(floor(o_totalprice / 20000) AS BIGINT) AS pages,
               CASE o_orderstatus WHEN 'F' THEN 'end_of_results' WHEN 'O' THEN 'known_page' ELSE 'cap_hit' END AS stop_reason FROM orders)"""
_AGE = lambda c: f"CAST(epoch(TIMESTAMP '{NOW}') - epoch({c}) AS DOUBLE)"
_HM = lambda m: f"CASE WHEN {m} >= 60 THEN CAST({m} // 60 AS VARCHAR) || 'h' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0') || 'm' ELSE CAST({m} AS VARCHAR) || 'm' END"
_LABELS = """l AS (
        SELECT 'k' || doc_id AS posting_key, CASE WHEN max(toxic) = 1 THEN 'not_for_me' ELSE 'golden' END AS label, CASE WHEN max(quality) = 1 THEN doc_id END AS job_id FROM labels GROUP BY doc_id)"""
_REPORT = f"""
        t AS (SELECT tier, CAST(max(class) AS DOUBLE) AS attempts, CASE WHEN min(class) = 1 THEN 1.0 ELSE 0.0 END AS ok, CAST(count(*) AS DOUBLE) AS fetched, CAST(count(*) FILTER (WHERE status = 'F') AS DOUBLE) AS scored,
                     CAST(count(*) FILTER (WHERE status = 'F' AND price >= 300000) AS DOUBLE) AS strong FROM tiered WHERE tier IS NOT NULL GROUP BY 1),
        m AS (SELECT CAST(host % 4 + 1 AS VARCHAR) || '/' || stage || '/' || coalesce(model, 'no response') AS name, CAST(count(*) AS DOUBLE) AS calls, CAST(count(*) FILTER (WHERE outcome <> 'ok') AS DOUBLE) AS failed,
                     CAST(sum(tokens) AS DOUBLE) AS tokens FROM calls GROUP BY 1)"""

ORACLES = {
    "archived_children": """
        SELECT source, count(*) AS n FROM (SELECT -1 AS source FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT l_suppkey % 5 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') GROUP BY 1""",
    "first_offers": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS k FROM lineitem) SELECT l_orderkey AS link, l_linenumber AS place, l_suppkey AS source FROM n WHERE k = 1",
    "labels_by_note": "SELECT 'k' || p_partkey AS posting_key, p_partkey AS job_id FROM part WHERE p_size % 3 <> 0",
    "canonical_links": f"""
        WITH {TIERED}, u AS (SELECT company, class, first_seen, id, 'https://' || CASE class WHEN 1 THEN 'careers.example.org' WHEN 2 THEN 'www.reed.co.uk' WHEN 3 THEN 'de.indeed.com' WHEN 4 THEN 'linkedin.com' END || '/' || id AS url FROM tiered),
        n AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY url IS NULL, class <> 1, first_seen, id) AS k FROM u)
        SELECT company, url AS canonical_url FROM n WHERE k = 1""",
    "trailing_share_since_errors": f"""
        WITH {REQUEST_LOG}, m AS (SELECT *, count(*) FILTER (WHERE outcome = 'error') OVER (PARTITION BY host ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stint FROM log)
        SELECT event_id, count(*) OVER w AS in_window, count(*) FILTER (WHERE outcome = 'refused') OVER w AS refused_in FROM m WINDOW w AS (PARTITION BY host, stint ORDER BY seen_at, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "keyword_scores": r"""
        WITH d AS (SELECT lower(coalesce(text, '')) AS t FROM documents)
        SELECT CAST(least(10, 1 + CASE WHEN regexp_matches(t, '\briver\b') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '\bhouse\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '\band\b') THEN 2 ELSE 0 END) AS INTEGER) AS score, count(*) AS n FROM d GROUP BY 1""",
    "second_feed_cards": """
        SELECT p_partkey, p_name AS title, p_brand AS company, CASE p_size % 6 WHEN 0 THEN 'Italy, Peru' ELSE '' END AS location, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1791978330 + p_partkey) AS posted_at, 'Bread' AS description
        FROM part WHERE p_size % 6 IN (0, 2, 4) AND p_size % 7 <> 0""",
    "digest_blocks": f"""
        WITH {TIERED}, t AS (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY price DESC, id) AS rank FROM tiered WHERE status = 'F' AND tier IS NOT NULL),
        s AS (SELECT *, row_number() OVER (ORDER BY tier, rank) <= 30 AS shown FROM t WHERE rank <= 20),
        g AS (SELECT tier, count(*) AS n, count(*) FILTER (WHERE shown) AS k, string_agg(chr(10) || '- posting ' || id, '' ORDER BY rank) FILTER (WHERE shown) AS lines FROM s GROUP BY 1)
        SELECT tier, 'Tier ' || tier || ' (' || n || ')' || coalesce(lines, '') || CASE WHEN n > k THEN chr(10) || 'and ' || (n - k) || ' more' ELSE '' END AS block FROM g""",
    "cv_roles": """
        WITH b AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 0) AS built FROM part GROUP BY 1)
        SELECT p_brand, NULL AS section, 'text' AS kind, 1 AS n, 0 AS sentences, 0 AS roles FROM b UNION ALL SELECT p_brand, s, 'section', 1, 0, 0 FROM b, (VALUES ('Summary'), ('Experience'), ('Skills')) AS v(s)
        UNION ALL SELECT p_brand, 'Summary', 'text', 1, 0, 0 FROM b UNION ALL SELECT p_brand, 'Experience', 'role', n, 0, n FROM b UNION ALL SELECT p_brand, 'Experience', 'bullet', 2 * n, n + built, n FROM b
        UNION ALL SELECT p_brand, 'Skills', 'skill', 1, 0, 0 FROM b UNION ALL SELECT p_brand, 'Skills', 'proof', 1, 0, 0 FROM b""",
    "day_summary": f"""
        WITH {JOBS}, {CALL_LOG},
        f AS (SELECT jobs.tier, count(*) AS n FROM lineitem JOIN jobs ON l_orderkey = id WHERE l_shipdate BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}' GROUP BY 1),
        k AS (SELECT tier, count(*) AS n FROM jobs WHERE shown_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}' GROUP BY 1),
        d AS (SELECT *, stage = 'delivered' AND first_seen BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}' AS sent FROM jobs),
        t AS (SELECT tier, count(*) FILTER (WHERE sent) AS delivered, count(*) FILTER (WHERE sent AND score >= CASE tier WHEN 1 THEN 8 WHEN 2 THEN 7 WHEN 3 THEN 6 END) AS strong, count(*) FILTER (WHERE stage IN ('seen', 'described')) AS waiting FROM d GROUP BY 1),
        x AS (SELECT t.*, coalesce(f.n, 0) AS found, coalesce(k.n, 0) AS packaged FROM t LEFT JOIN f ON t.tier IS NOT DISTINCT FROM f.tier LEFT JOIN k ON t.tier IS NOT DISTINCT FROM k.tier),
        b AS (SELECT status || '-' || class AS service, max(first_seen) AS beat_at FROM tiered WHERE first_seen <= TIMESTAMP '{NOW}' GROUP BY 1),
        c AS (SELECT stage, count(*) AS requests, sum(tokens) AS tokens FROM calls GROUP BY 1)
        SELECT 'tier' AS section, coalesce(CAST(tier AS VARCHAR), '-') AS name, metric, CAST(value AS DOUBLE) AS value FROM (SELECT tier, unnest(['found', 'delivered', 'strong', 'packaged', 'waiting']) AS metric, unnest([found, delivered, strong, packaged, waiting]) AS value FROM x)
        UNION ALL SELECT 'source', CAST(l_suppkey % 5 AS VARCHAR), 'found', CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}' GROUP BY 2
        UNION ALL SELECT 'provider', stage, 'requests', CAST(requests AS DOUBLE) FROM c UNION ALL SELECT 'provider', stage, 'tokens', CAST(tokens AS DOUBLE) FROM c
        UNION ALL SELECT 'service', service, 'silent', CASE WHEN epoch(TIMESTAMP '{NOW}') - epoch(beat_at) > 36 * 3600 THEN 1.0 ELSE 0.0 END FROM b""",
    "status_view": f"""
        WITH {JOBS}, {_SLICES},
        s AS (SELECT coalesce(CAST(tier AS VARCHAR), '-') || '/' || stage AS name, count(*) AS n, max({_AGE('first_seen')}) AS age FROM jobs GROUP BY 1),
        q AS (SELECT coalesce(CAST(tier AS VARCHAR), '-') || '/' || coalesce(CAST(CASE WHEN score < 9 THEN score % 3 END AS VARCHAR), 'unclassified') AS name, count(*) AS n, max({_AGE('first_seen')}) AS age FROM jobs WHERE stage = 'seen' GROUP BY 1),
        w AS (SELECT source AS name, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE active AND due_at <= TIMESTAMP '{NOW}') AS due, min({_AGE('walked_at')}) AS age FROM slices GROUP BY 1)
        SELECT 'stage' AS section, name, 'jobs' AS metric, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'stage', name, 'oldest_s', age FROM s
        UNION ALL SELECT 'expired', coalesce(stage_reason, '-'), 'jobs', CAST(count(*) AS DOUBLE) FROM jobs WHERE stage = 'expired' AND first_seen >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 2
        UNION ALL SELECT 'queue', name, 'jobs', CAST(n AS DOUBLE) FROM q UNION ALL SELECT 'queue', name, 'oldest_s', age FROM q
        UNION ALL SELECT 'slices', name, 'active', CAST(active AS DOUBLE) FROM w UNION ALL SELECT 'slices', name, 'due', CAST(due AS DOUBLE) FROM w UNION ALL SELECT 'slices', name, 'last_walk_s', age FROM w""",
    "day_report": f"""
        WITH {TIERED}, {CALL_LOG}, {_REPORT}
        SELECT 'tier' AS section, CAST(tier AS VARCHAR) AS name, unnest(['attempts', 'ok', 'fetched', 'scored', 'strong']) AS metric, unnest([attempts, ok, fetched, scored, strong]) AS value FROM t
        UNION ALL SELECT 'model', name, unnest(['calls', 'failed', 'tokens']), unnest([calls, failed, tokens]) FROM m""",
    "day_report_lines": f"""
        WITH {TIERED}, {CALL_LOG}, {_REPORT}
        SELECT 'tier' AS section, CAST(tier AS VARCHAR) AS name, tier || ': attempts ' || CAST(attempts AS BIGINT) || ', fetched ' || CAST(fetched AS BIGINT) || ', ok ' || CAST(ok AS BIGINT) || ', scored ' || CAST(scored AS BIGINT) || ', strong ' || CAST(strong AS BIGINT) AS line FROM t""",
    "run_rule_warnings": f"""
        WITH {REQUEST_LOG}, g AS (SELECT host, count(*) AS fetched, count(*) FILTER (WHERE status = 429) AS s429, count(*) FILTER (WHERE status = 403) AS d429, count(*) FILTER (WHERE status = 503) AS deferred, count(*) FILTER (WHERE digit >= 8) AS other,
                                         count(*) FILTER (WHERE digit > 2) AS answered, count(*) FILTER (WHERE digit = 3) AS cut FROM log GROUP BY 1)
        SELECT host, 'not recorded' AS warning FROM g WHERE host % 10 = 0 UNION ALL SELECT host, 'crashed' FROM g WHERE host % 10 = 1 AND host % 20 = 1 UNION ALL SELECT host, 'failed' FROM g WHERE host % 10 = 2
        UNION ALL SELECT host, 'several attempts' FROM g WHERE host % 3 > 1 UNION ALL SELECT host, 'verification degraded' FROM g WHERE host % 7 = 0 UNION ALL SELECT host, 'verification batches failed' FROM g WHERE host % 7 <> 0 AND host % 5 > 0
        UNION ALL SELECT host, 'telemetry incomplete' FROM g WHERE host % 11 = 0 UNION ALL SELECT host, 'many rate limits' FROM g WHERE s429 + d429 > 12 UNION ALL SELECT host, 'gave up on rate limits' FROM g WHERE host % 13 = 0
        UNION ALL SELECT host, 'many deferred' FROM g WHERE fetched > 0 AND CAST(deferred AS DOUBLE) / fetched > 0.15 UNION ALL SELECT host, 'searches cut short' FROM g WHERE cut > 0
        UNION ALL SELECT host, 'answered by another model' FROM g WHERE other >= 3 AND CAST(other AS DOUBLE) / answered > 0.3 UNION ALL SELECT host, 'limit nearly used' FROM g WHERE fetched >= 54""",
    "fair_claim": f"""
        WITH {_SLICES}, s AS (SELECT tier, max(o_orderdate) AS served_at FROM orders JOIN slices ON o_custkey = slice GROUP BY 1)
        SELECT slice, tier, due_at, served_at FROM slices LEFT JOIN s USING (tier) WHERE active AND due_at <= TIMESTAMP '{NOW}' ORDER BY served_at NULLS FIRST, due_at, tier, slice LIMIT 25""",
    "class_backfill": f"WITH {TIERED} SELECT id, class + 10 AS cls, first_seen FROM tiered WHERE class > 3 AND status = 'O' ORDER BY first_seen, id LIMIT 200",
    "verdict_mix": f"""
        WITH {JOBS} SELECT coalesce(CASE WHEN tier <> 4 THEN 'p' || tier END, 'none') AS provider, count(*) FILTER (WHERE remote_verdict = 'confirmed') AS confirmed, count(*) FILTER (WHERE remote_verdict = 'rejected') AS rejected,
               count(*) FILTER (WHERE remote_verdict = 'not_stated') AS not_stated FROM jobs GROUP BY 1""",
    "area_pages": f"WITH {_WALKS} SELECT area, count(*) AS walks, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(pages) AS DOUBLE) / count(*) AS mean_pages FROM walks WHERE walked_at > TIMESTAMP '{NOW}' - INTERVAL 336 HOUR AND walked_at <= TIMESTAMP '{NOW}' GROUP BY 1",
    "late_slices": f"WITH {_SLICES} SELECT slice, CAST({_AGE('due_at')} AS BIGINT) AS late_s FROM slices WHERE active AND {_AGE('due_at')} > 3600",
    "walk_stop_reasons": f"WITH {_WALKS} SELECT tier, stop_reason, count(*) AS walks FROM walks WHERE walked_at > TIMESTAMP '{NOW}' - INTERVAL 336 HOUR AND walked_at <= TIMESTAMP '{NOW}' GROUP BY 1, 2",
    "model_answers": f"""
        WITH {CALL_LOG}, c AS (SELECT stage, model, count(*) AS n FROM calls GROUP BY 1, 2)
        SELECT stage, CAST(sum(n) AS BIGINT) AS calls, CAST(coalesce(sum(n) FILTER (WHERE model IS NULL), 0) AS BIGINT) AS unanswered, string_agg(model || ':' || n, ' ' ORDER BY n DESC, model) FILTER (WHERE model IS NOT NULL) AS answers FROM c GROUP BY 1""",
    "last_attempts": f"WITH {REQUEST_LOG} SELECT host, max(event_id) AS attempts, arg_max(source, event_id) AS source, arg_max(outcome, event_id) AS outcome FROM log GROUP BY 1",
    "call_gates": f"""
        WITH {CALL_LOG}, d AS (SELECT CAST(seen_at AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE stage = 'click') AS stage_requests FROM calls GROUP BY 1)
        SELECT *, requests < 40 AND stage_requests < 16 AS may_call FROM d""",
    "waiting_queue": f"""
        WITH {JOBS}, d AS (SELECT *, CASE WHEN score % 2 = 0 THEN 'pending' WHEN score % 3 = 0 THEN 'rate_limited' ELSE 'ok' END AS description_status FROM jobs)
        SELECT tier, description_status, count(*) AS n FROM d WHERE stage = 'seen' AND tier IS NOT NULL AND description_status <> 'ok' AND first_seen + INTERVAL 100 DAY <= TIMESTAMP '{NOW}' GROUP BY 1, 2""",
    "undone_rule": f"WITH {JOBS} SELECT CASE WHEN stage_reason = 'language:2' THEN 'seen' ELSE stage END AS stage, CASE WHEN stage_reason = 'language:2' THEN '' ELSE stage_reason END AS stage_reason, count(*) AS n FROM jobs GROUP BY 1, 2",
    "reason_census": f"WITH {JOBS} SELECT split_part(stage_reason, ':', 1) AS reason, count(*) AS n FROM jobs GROUP BY 1",
    "cheap_picks": f"WITH {JOBS} SELECT id, first_seen FROM jobs WHERE stage = 'seen' AND (tier IS NULL OR score > 5) ORDER BY first_seen, id LIMIT 100",
    "deferred_rows": f"""
        WITH {TIERED} SELECT id, CASE WHEN status = 'O' THEN class + 1 ELSE class END AS attempts,
               CASE WHEN status = 'O' THEN TIMESTAMP '{NOW}' + to_seconds(CAST(least(43200, 1800 * pow(2, class)) AS BIGINT)) ELSE first_seen END AS next_attempt_at FROM tiered""",
    "stage_log": f"WITH {REQUEST_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seen_at DESC, event_id DESC) AS k FROM log) SELECT host AS id, source AS stage, outcome AS reason FROM n WHERE k = 1",
    "description_states": """
        WITH p AS (SELECT p_size % 4 AS k, CASE p_size % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'failed' ELSE 'ok' END AS s FROM part)
        SELECT CASE WHEN k IN (0, 1) THEN 'failed' ELSE s END AS status, k = 0 AS stands_in, count(*) AS n FROM p GROUP BY 1, 2""",
    "text_formats": f"""
        WITH p AS (SELECT *, CASE WHEN p_size % 9 <> 0 THEN p_partkey * p_size END AS t, p_size * 1000 // 60 AS a, CASE WHEN p_size % 7 <> 0 THEN p_partkey * 7 // 60 END AS d FROM part)
        SELECT p_partkey, CASE WHEN t IS NULL THEN '-' WHEN t >= 1000 THEN CAST(CAST(round_even(t / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST(t AS VARCHAR) END AS tokens, {_HM('a')} AS age, CASE WHEN d IS NULL THEN '?' ELSE {_HM('d')} END AS duration,
               p_brand AS model, '&lt;b&gt;' || replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '&lt;/b&gt; &amp; co' AS html FROM p""",
    "prompt_texts": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(least(6000, greatest(1500, 24000 // (doc_id % 12 + 1))) AS INTEGER) AS b, CASE WHEN doc_id % 2 = 0 THEN chr(10) || '...' || chr(10) || 'Remote or not?' ELSE '' END AS e FROM documents),
        c AS (SELECT doc_id, CASE WHEN length(t) <= b THEN t ELSE substr(t, 1, b - length(e)) || e END AS c FROM d)
        SELECT doc_id, CAST(length(c) AS INTEGER) AS chars, md5(c) AS md5 FROM c""",
    "link_keys": """
        WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://de.linkedin.com/jobs/view/some-role-' || (page_id + 10000) WHEN 1 THEN 'https://linkedin.cn/x/' || (page_id + 10000) || '/' ELSE url END AS u FROM pages)
        SELECT page_id, CASE WHEN page_id % 3 < 2 THEN CAST(page_id + 10000 AS VARCHAR) ELSE 'legacy:' || md5(u) END AS legacy_key, substr(sha256(u), 1, 12) AS version, 'postgres://user:***@host/db' AS shown, page_id AS note FROM p""",
    "quotes_found": """
        WITH p AS (SELECT CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') ELSE 'no' END AS q, p_name AS n FROM part),
        k AS (SELECT regexp_replace(lower(q), '[^a-z0-9]', '', 'g') AS q, 'note' || regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS n FROM p)
        SELECT length(q) >= 4 AND contains(n, q) AS found, count(*) AS n FROM k GROUP BY 1""",
    "labels_in_force": f"WITH {_LABELS} SELECT posting_key, label, job_id FROM l",
    "label_gaps": f"WITH {_LABELS} SELECT label, count(*) AS labels, count(*) FILTER (WHERE job_id IS NULL) AS without_job FROM l GROUP BY 1",
    "rekeyed_sightings": """
        WITH r AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders)
        SELECT coalesce(root, l_orderkey) AS id, count(*) AS sightings FROM lineitem LEFT JOIN r ON l_orderkey = id GROUP BY 1""",
    "retry_queue": f"""
        WITH {TIERED}, q AS (SELECT 'l' || id AS link, CASE WHEN class % 2 = 0 THEN 'throttled' ELSE 'scoring' END AS kind, CASE WHEN status <> 'F' THEN first_seen ELSE TIMESTAMP '{NOW}' END AS queued_at FROM tiered WHERE status <> 'P')
        SELECT * FROM q WHERE CASE WHEN kind = 'throttled' THEN date_diff('day', CAST((queued_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome' AS DATE), DATE '1998-06-01') < 30 ELSE queued_at > TIMESTAMP '{NOW}' - INTERVAL 60 DAY END""",
    "todays_copies": f"""
        WITH {TIERED} SELECT 'l' || id AS link, CASE WHEN status = 'F' THEN CASE WHEN class > 2 THEN 'new ' || id ELSE '' END WHEN status = 'P' THEN CASE WHEN class > 1 THEN 'old ' || id ELSE '' END
               WHEN class > 2 THEN 'new ' || id WHEN class > 1 THEN 'old ' || id ELSE '' END AS description FROM tiered""",
    "clamped_cadence": f"""
        WITH {_SLICES}, h AS (SELECT *, CAST(least(48, greatest(12, slice % 70)) AS INTEGER) AS hours FROM slices)
        SELECT slice, hours, CASE WHEN tier = 1 OR NOT active THEN due_at ELSE least(due_at, walked_at + to_hours(hours)) END AS due_at FROM h""",
    "due_tests": f"""
        WITH {TIERED}, t AS (SELECT company, min(first_seen) AS oldest, max(first_seen) AS latest FROM tiered WHERE status = 'O' GROUP BY 1), n AS (SELECT *, latest + INTERVAL 200 HOUR AS now FROM t),
        r AS (SELECT *, (now AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome' AS here, CAST((latest AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome' AS DATE) AS began FROM n)
        SELECT company, epoch(now) - epoch(oldest) > 24 * 60 * 3600 AS is_overdue, CASE WHEN hour(here) >= 8 THEN CAST(here AS DATE) END AS deliver, CAST(CASE WHEN company % 5 = 0 THEN 30 ELSE 10 END AS BIGINT) AS days, began < CAST(here AS DATE) AS is_over FROM r""",
    "verdict_policies": f"""
        WITH {JOBS}, v AS (SELECT tier, CASE WHEN score = 2 THEN 'not_stated' ELSE coalesce(remote_verdict, 'not_checked') END AS verdict FROM jobs)
        SELECT verdict, NOT (tier = 1) OR verdict NOT IN ('not_stated', 'rejected') AS alerts, verdict IN ('confirmed', 'not_checked') AS packages,
               CASE verdict WHEN 'confirmed' THEN 'Confirmed full-remote' WHEN 'not_stated' THEN 'Work mode not stated' ELSE 'Other' END AS section, count(*) AS n FROM v GROUP BY 1, 2, 3, 4""",
    "answer_verdicts": f"""
        WITH {JOBS} SELECT CASE id % 5 WHEN 0 THEN CASE WHEN score > 6 THEN 'confirmed' WHEN score > 3 THEN 'advised' ELSE 'not_stated' END WHEN 3 THEN 'not_stated' WHEN 4 THEN NULL
               ELSE CASE WHEN score % 2 = 0 THEN 'rejected' ELSE 'not_stated' END END AS verdict, count(*) AS n FROM jobs GROUP BY 1""",
    "answers_by_place": """
        WITH n AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS n, count(*) OVER (PARTITION BY role) AS a FROM conversations)
        SELECT role, conv_id, turn, n // 8 AS batch, n % 8 AS place, CASE WHEN n % 8 < 7 THEN n // 8 * 100 + n % 8 END AS answer FROM n WHERE (n // 8 + 1) * 8 <= a""",
    "recovered_alerts": f"""
        WITH {REQUEST_LOG}, s AS (SELECT concat_ws('/', host, source) AS key, max(seen_at) AS sent_at FROM log WHERE outcome = 'refused' GROUP BY 1)
        SELECT key, sent_at, 'recovered' AS note FROM s WHERE sent_at < TIMESTAMP '2024-01-20 00:00:00'""",
}
