"""Queries over names, pages, documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import geo, text
from millrace.functions.timeutil import at
from millrace.operators import calls, labels, messages, queueing, rules
from millrace.plans.tables import table
from millrace.sources import feeds, pages, store

LANGUAGES = ("en", "es", "it")
KEYWORDS = ["small", "red", "old", "bolt"]


#: Names in letters of several languages written in Latin, and with marks that stand apart.
_NAMES = ("Petr Čech", "Plzeň", "Győr", "Iași", "Łódź", "Ångström", "Đà Nẵng", "Cafe\u0301 Ole\u0301", "İzmir", "Þórshöfn", "Œuvre", "Straße", "ŽIŽEK", "São Tomé", "Ħal Qormi")


def title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    raw = F.concat(F.lit("Ré. "), "p_name", F.lit(" (m/f/d) — N. "), "p_brand", F.lit("'s "), F.element_at(names, (F.col("p_partkey") % len(_NAMES) + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_title(raw).alias("title_norm"))


def company_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = (" GmbH & Co. KG", " S.p.A.", " Générale S.A.", " Ltd", " Labs", " S.r.l.s.", " Oyj", " Pty. Limited", " Incorporated", " Kft & Company", " SpA Trading", " s.r.o.", " Corporation LLP")
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("c_custkey") % len(tails) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_company(F.concat("c_name", tail)).alias("company_norm"))


def posting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.posting_key(F.col("url")).alias("posting_key"))


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, a part of them moved to boards, to hosts below and to hosts that only end like them."""
    hosts = ("", "linkedin.com", "de.indeed.com", "myindeed.com", "www.reed.co.uk", "uk.jooble.org", "jobs.workable.com", "apply.workable.com", "adzuna.com.example.org", "trovolavoro.it", "careers.example.org")
    other = F.element_at(F.array(*map(F.lit, hosts)), (F.col("page_id") % len(hosts) + 1).cast("int"))
    url = F.when(other == "", F.col("url")).otherwise(F.concat(F.lit("https://"), other, F.lit("/jobs/"), F.col("page_id").cast("string")))
    p = table(spark, sf_dir, "pages").select(url.alias("url"))
    return p.groupBy(text.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(text.is_company_page(F.col("url"))).alias("own"))


def note_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" – "), "p_type", F.lit(" / "), "p_brand"), 24).alias("slug"))


def title_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(text.first_keyword(F.col("p_name"), KEYWORDS).alias("keyword")).agg(F.count("*").alias("n"))


def title_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = queueing.class_of((F.col("p_size") % 3 + 1), F.col("p_name"), F.col("p_type").isin("ECONOMY", "PROMO"), r"\b(red|blue|hot)\b", r"\bgear\b")
    return table(spark, sf_dir, "part").select("p_partkey", cls.cast("long").alias("cls"))


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = text.language_passes(F.col("text"), F.col("lang"), LANGUAGES)
    return table(spark, sf_dir, "documents").groupBy("lang", passes.alias("passes")).agg(F.count("*").alias("n"))


def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the small words of each text say, where they say something."""
    return table(spark, sf_dir, "documents").select("doc_id", text.detected_language(F.col("text")).alias("detected"))


#: Invented postings, and what becomes of them where eligibility counts.
CASES = (
    ("Fully remote position. Remote (UK) only.", None, "advised", "remote, limited to the UK - check eligibility"),
    ("Remote-first bakery. Remote - Italy.", None, "confirmed", ""),
    ("We are a fully remote team.", None, None, ""),
    ("This isn't a fully remote job.", None, None, ""),
    ("Hybrid working pattern, 3+ days office attendance.", None, "rejected", ""),
    ("Two days per week in the office.", "remote", "rejected", ""),
    ("2 days a year in the office.", None, None, ""),
    ("Occasional on-site presence at the mill.", None, None, ""),
    ("Remote (optional) or hybrid.", None, None, ""),
    ("Experience with hybrid cloud ovens.", None, "not_stated", ""),
    ("Experience with hybrid cloud ovens.", "remote", "advised", "the source marks it remote - check eligibility"),
    ("We bake.", "onsite", "rejected", ""),
    ("Fully remote, whatever they say.", "hybrid", None, ""),
    ("Lavoro ibrido, tre giorni in sede.", None, "rejected", ""),
    ("Contratto 100% da remoto (Italia).", None, "confirmed", ""),
    ("Présentiel, quatre jours au bureau.", None, "rejected", ""),
    ("Teletrabajo al 100%.", None, None, ""),
    ("Drei Tage im Büro.", None, "rejected", ""),
    ("A strong market presence.", None, "not_stated", ""),
    ("Offriamo la possibilità di lavoro da remoto.", None, None, ""),
    ("We don't offer fully remote.", None, None, ""),
    ("We cannot offer a fully remote role.", None, None, ""),
    ("You are at the office on Mondays.", None, None, ""),
    ("3x a week in the office, we say.", None, None, ""),
)
PADDING = " We bake bread for forty shops, mill our own flour and pay a fair wage with training and meals." * 3


def work_mode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as postings: each has one of the cases' sentences between two about the part itself."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").repartition("p_partkey")  # a compact file is one task's otherwise
    which = (F.col("p_partkey") % len(CASES) + 1).cast("int")
    said, hint = (F.element_at(F.array(*(F.lit(c[k]) for c in CASES)), which) for k in (0, 1))
    ready = p.select("p_partkey", F.concat(F.lit("We sell "), "p_name", F.lit(". "), said, F.lit(PADDING), F.lit(" Ask for "), "p_type", F.lit(".")).alias("description"), hint.alias("remote_hint"), F.lit("Baker").alias("title"), F.lit("Turin, Italy").alias("location"))
    return rules.rule_stage(ready, F.lit(True), True).select("p_partkey", "remote_verdict", "remote_advice")


def country_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries named in sentences made of the nations' names."""
    n = table(spark, sf_dir, "nation")
    said = F.concat(F.lit("Our team in "), F.initcap("n_name"), F.lit(" works with UK partners, tell us more, or join the us-based crew."))
    return n.select("n_nationkey", F.array_join(geo.countries_in(said), ", ").alias("named"))


def work_mode_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every document, with a sentence put before it by its identifier."""
    lead = F.array(*(F.lit(x) for x in ("", "This is a fully remote role. ", "Two days per week in the office. ", "Remote (UK). ", "We meet at the office twice a year. ", "Not a fully remote position. ")))
    d = table(spark, sf_dir, "documents").withColumn("description", F.concat(F.element_at(lead, (F.col("doc_id") % 6 + 1).cast("int")), F.coalesce("text", F.lit(""))))
    hint = F.when(F.col("doc_id") % 17 == 0, "hybrid").when(F.col("doc_id") % 13 == 0, "remote")
    ready = d.select("doc_id", "description", F.lit("").alias("title"), F.lit("").alias("location"), hint.alias("remote_hint"))
    return rules.rule_stage(ready, F.lit(True), True).select("doc_id", "remote_verdict", "remote_reason", "remote_advice")


def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.description_udf()("html", F.lit("Page"), F.lit("Site")).alias("d")
    return table(spark, sf_dir, "pages").select("page_id", found).select("page_id", F.length("d.text").alias("chars"), "d.status")


def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards parsed back from result pages made of the parts' names."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    card = F.concat(F.lit('<li><div data-entity-urn="urn:li:jobPosting:'), F.col("p_partkey").cast("string"), F.lit('"><a class="base-card__full-link" href="https://jobs.example.com/'), F.col("p_partkey").cast("string"), F.lit('"></a><h3 class="base-search-card__title">'), "p_name", F.lit('</h3><h4 class="base-search-card__subtitle"><a>'), "p_brand", F.lit("</a></h4></div></li>"))
    html = p.groupBy(F.floor(F.col("p_partkey") / 25).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("html"))
    found = html.select(F.explode(pages.cards_udf()(F.concat(F.lit("<ul>"), "html", F.lit("</ul>")))).alias("c"))
    return found.select(F.col("c.job_id").cast("long").alias("p_partkey"), "c.title", "c.company", "c.url")


def application_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, a part of them on hosts of application systems or with marks of the other ways to apply."""
    k = F.col("page_id") % 7
    url = F.when(k == 0, F.concat(F.lit("https://jobs.lever.co/x/"), F.col("page_id").cast("string"))).when(k == 1, "https://acme.myworkdayjobs.com/y").when(k == 2, "https://notlever.co/z").otherwise(F.col("url"))
    mark = F.when(k == 3, "<p>Easy Apply here</p>").when(k == 4, '<a href="mailto:jobs@example.org">write</a>').when(k == 5, "<h1>Please verify you are human</h1>").otherwise("")
    p = table(spark, sf_dir, "pages").select(url.alias("url"), F.concat(F.coalesce("html", F.lit("")), mark).alias("html"))
    return p.groupBy(pages.application_channel(F.col("url"), F.col("html")).alias("channel"), pages.is_challenge(F.col("html")).alias("challenge")).agg(F.count("*").alias("n"))


def not_seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"))
    return store.not_known(table(spark, sf_dir, "benchmark"), known, F.md5("text")).select("item_id")


def label_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels find their documents by a first list that holds the English ones, and else by one of the short and the foreign ones."""
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("posting_key")
    log = table(spark, sf_dir, "labels").select(key, F.when(F.col("toxic") == 1, "not_for_me").otherwise("golden").alias("label"), F.lit(None).cast("long").alias("job_id"))
    docs = table(spark, sf_dir, "documents")
    by_key = docs.filter("lang = 'en'").select(key, F.col("doc_id").alias("job_id"))
    by_source = docs.filter("lang IS NULL OR lang <> 'en' OR n_chars < 2000").select(key, (-F.col("doc_id")).alias("job_id"))
    return labels.resolve_by_priority(log, [by_key, by_source])


def agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    clean = F.col("toxic") == 0
    guesses = {"short": F.when(F.col("n_chars") < 3000, F.lit(True)), "english": F.col("lang") == "en", "quality": F.when(F.col("quality") == 1, F.lit(True))}
    return calls.agreement(d, {name: (g, clean) for name, g in guesses.items()})


def due_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("conv_id") % 60).cast("int"))).alias("stage_changed_at"))
    return queueing.due_batches(c, 8, at("2024-01-01 00:10:00"), 1800, ["role", "turn"], ["stage_changed_at", "conv_id"]).select("role", "turn", "conv_id", "batch", "place")


def message_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.message_sizes(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def golden_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of all texts that one side has more often, compared as multisets of rows; :func:`golden_line_diff` counts first."""
    lines = lambda name: table(spark, sf_dir, name).select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return messages.golden_diff(lines("documents"), lines("benchmark")).groupBy("line", "side").agg(F.count("*").alias("n"))


def golden_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.line_diff(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def feed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    item = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("public_slug"), F.concat(F.lit("https://x.example.com/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_partkey") % 7 != 0, F.concat("p_name", F.lit(" &amp; <b>more</b>"))).alias("title"), F.col("p_brand").alias("company"), F.when(F.col("p_partkey") % 5 == 0, "2024-01-01").alias("closed_at"), F.array(F.lit("IT")).alias("countries"), F.lit("2024-02-03T04:05:06Z").alias("posted_at"), F.struct(F.when(F.col("p_partkey") % 11 == 0, "evergreen").otherwise("real").alias("class")).alias("reality")))
    broken = F.when(F.col("p_partkey") % 13 == 0, '{"public_slug": ').otherwise(item)
    return feeds.first_feed(p.select(broken.alias("json"))).select(F.col("job_id").cast("long").alias("p_partkey"), "title", "company", "country_code", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


def walk_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("walk"), "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    n = l.groupBy("walk", F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"), F.max("l_suppkey").alias("s"))
    log = n.select("walk", "n", F.when(F.col("q") > 45, 0).otherwise(25).alias("cards"), F.when(F.col("s") % 2 == 0, 25).otherwise(3).alias("known"), F.when(F.col("q") < 8, "refused").when(F.col("q") == 8, "error").otherwise("ok").alias("outcome"), F.lit(None).cast("int").alias("area_cap"))
    return feeds.walk_stops(log, 5).groupBy("stop_reason").agg(F.count("*").alias("walks"), F.sum("pages").alias("pages"))


QUERIES = {
    f.__name__: f
    for f in (
        title_norm, company_norm, posting_keys, url_hosts, note_slugs, title_prefilter, title_class, language_gate, detected_languages, work_mode_rules, work_mode_cases, country_mentions, page_descriptions, page_cards, application_channels,
        not_seen_before, label_backfill, agreement_rate, due_batches, message_packing, golden_diff, golden_line_diff, feed_cards, walk_stops,
    )
}

_NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[.''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_HOST = "nullif(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '')"
_WORD = lambda w: f"regexp_matches(p_name, '(?i)(^|[^[:word:]+]){w}($|[^[:word:]+])')"

ORACLES = {
    "title_norm": "SELECT p_partkey, " + _NORM.format("'Ré. ' || p_name || ' (m/f/d) — N. ' || p_brand || '''s ' || [" + ", ".join(f"'{x}'" for x in _NAMES) + "][p_partkey % 15 + 1]") + " AS title_norm FROM part",
    # the legal forms are written out, apart from the list under test
    "company_norm": f"""
        SELECT c_custkey, {_NORM.format('c_name')} || CASE c_custkey % 13 WHEN 2 THEN ' generale' WHEN 4 THEN ' labs' WHEN 10 THEN ' spa trading' ELSE '' END AS company_norm FROM customer""",
    "posting_keys": f"SELECT page_id, {_HOST} || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS posting_key FROM pages",
    "url_hosts": f"""
        WITH p AS (SELECT CASE page_id % 11 WHEN 0 THEN url ELSE 'https://' || list_extract(['', 'linkedin.com', 'de.indeed.com', 'myindeed.com', 'www.reed.co.uk', 'uk.jooble.org', 'jobs.workable.com', 'apply.workable.com',
                                 'adzuna.com.example.org', 'trovolavoro.it', 'careers.example.org'], page_id % 11 + 1) || '/jobs/' || page_id END AS url FROM pages),
        h AS (SELECT {_HOST} AS host FROM p)
        SELECT host, count(*) AS n, count(*) FILTER (WHERE host NOT IN ('linkedin.com', 'de.indeed.com', 'www.reed.co.uk', 'uk.jooble.org', 'jobs.workable.com', 'trovolavoro.it')) AS own FROM h GROUP BY 1""",
    "note_slugs": r"SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' – ' || p_type || ' / ' || p_brand), '[^a-z0-9\s]', '', 'g'), '\s+', '_', 'g'), 1, 24) AS slug FROM part",
    "title_prefilter": f"SELECT CASE {' '.join(f"WHEN {_WORD(w)} THEN '{w}'" for w in KEYWORDS)} END AS keyword, count(*) AS n FROM part GROUP BY 1",
    "title_class": """
        WITH x AS (SELECT p_partkey, regexp_matches(p_name, '(?i)\\b(red|blue|hot)\\b') AND NOT regexp_matches(p_name, '(?i)\\bgear\\b') AS good, p_type IN ('ECONOMY', 'PROMO') AND p_size % 3 + 1 <> 2 AS wide FROM part)
        SELECT p_partkey, CAST(CASE WHEN good AND NOT wide THEN 1 WHEN good THEN 2 WHEN NOT wide THEN 3 ELSE 4 END AS BIGINT) AS cls FROM x""",
    "language_gate": "SELECT lang, coalesce(length(text) < 40 OR lang IS NULL OR lang IN ('en', 'es', 'it'), true) AS passes, count(*) AS n FROM documents GROUP BY 1, 2",
    "detected_languages": """
        WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-zäöüßàèéìòùáíóúñâêîôûç]+', ' ', 'g'), ' '), lambda x: x <> '') AS w, length(text) AS n FROM documents),
        c AS (SELECT doc_id, n, len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'to', 'with', 'for', 'is', 'that', 'are', 'you', 'was', 'this'))) AS en, len(list_filter(w, lambda x: x IN ('el', 'los', 'las', 'y', 'que', 'con', 'para', 'una', 'por', 'del', 'es', 'está'))) AS es,
                     len(list_filter(w, lambda x: x IN ('il', 'gli', 'che', 'di', 'e', 'con', 'per', 'una', 'della', 'sono', 'è', 'nel'))) AS it, len(list_filter(w, lambda x: x IN ('der', 'die', 'das', 'und', 'ist', 'mit', 'für', 'nicht', 'ein', 'auf', 'den', 'von'))) AS de,
                     len(list_filter(w, lambda x: x IN ('le', 'les', 'et', 'des', 'une', 'que', 'dans', 'pour', 'est', 'sur', 'avec', 'du'))) AS fr FROM w),
        m AS (SELECT *, greatest(en, es, it, de, fr) AS top FROM c)
        SELECT doc_id, CASE WHEN coalesce(n, 0) < 40 OR top < 2 OR (en = top)::INT + (es = top)::INT + (it = top)::INT + (de = top)::INT + (fr = top)::INT > 1 THEN NULL
                            WHEN en = top THEN 'en' WHEN es = top THEN 'es' WHEN it = top THEN 'it' WHEN de = top THEN 'de' ELSE 'fr' END AS detected FROM m""",
    "work_mode_cases": """
        SELECT p_partkey, remote_verdict, remote_advice FROM part JOIN (VALUES
            (0, 'advised', 'remote, limited to the UK - check eligibility'), (1, 'confirmed', ''), (2, NULL, ''), (3, NULL, ''), (4, 'rejected', ''), (5, 'rejected', ''), (6, NULL, ''), (7, NULL, ''), (8, NULL, ''),
            (9, 'not_stated', ''), (10, 'advised', 'the source marks it remote - check eligibility'), (11, 'rejected', ''), (12, NULL, ''), (13, 'rejected', ''), (14, 'confirmed', ''), (15, 'rejected', ''), (16, NULL, ''),
            (17, 'rejected', ''), (18, 'not_stated', ''), (19, NULL, ''), (20, NULL, ''), (21, NULL, ''), (22, NULL, ''), (23, NULL, '')) AS v(id, remote_verdict, remote_advice) ON p_partkey % 24 = id""",
    "country_mentions": """
        SELECT n_nationkey, 'the UK, the US' || CASE WHEN n_name IN ('FRANCE', 'GERMANY', 'ROMANIA', 'CANADA', 'INDIA', 'BRAZIL', 'JAPAN', 'CHINA') THEN ', ' || upper(n_name[1]) || lower(n_name[2:]) ELSE '' END AS named FROM nation""",
    "application_channels": """
        WITH p AS (SELECT page_id % 7 AS k, coalesce(html, '') || CASE page_id % 7 WHEN 3 THEN '<p>Easy Apply here</p>' WHEN 4 THEN '<a href="mailto:jobs@example.org">write</a>' WHEN 5 THEN '<h1>Please verify you are human</h1>' ELSE '' END AS html FROM pages)
        SELECT CASE WHEN k IN (0, 1) THEN 'external_ats' WHEN contains(lower(html), 'easy apply') THEN 'easy_apply' WHEN contains(lower(html), 'href="mailto:') OR contains(lower(html), 'href=''mailto:') THEN 'email' ELSE 'unknown' END AS channel,
               regexp_matches(lower(html), 'captcha|are you a robot|unusual traffic|verify you are human|security check') AS challenge, count(*) AS n FROM p GROUP BY 1, 2""",
    "walk_stops": """
        WITH n AS (SELECT l_orderkey AS walk, l_linenumber AS n, max(l_quantity) AS q, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
        g AS (SELECT walk, n, CASE WHEN q > 45 THEN 0 ELSE 25 END AS cards, CASE WHEN s % 2 = 0 THEN 25 ELSE 3 END AS known, CASE WHEN q < 8 THEN 'refused' WHEN q = 8 THEN 'error' ELSE 'ok' END AS o FROM n),
        p AS (SELECT *, count(*) FILTER (WHERE o = 'ok') OVER w AS page, max(cards) FILTER (WHERE o = 'ok') OVER w AS widest, max(n) FILTER (WHERE o <> 'refused') OVER w AS answered FROM g WINDOW w AS (PARTITION BY walk ORDER BY n ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT *, o = 'ok' AND known = cards AND cards >= widest AND cards > 0 AS is_known FROM p),
        r AS (SELECT *, count(*) FILTER (WHERE o = 'ok') OVER w - coalesce(max(page) FILTER (WHERE o = 'ok' AND NOT is_known) OVER w, 0) AS known_run,
                     count(*) FILTER (WHERE o = 'refused' AND n > coalesce(answered, 0)) OVER (PARTITION BY walk, answered ORDER BY n ROWS UNBOUNDED PRECEDING) AS refused_run
              FROM k WINDOW w AS (PARTITION BY walk ORDER BY n ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT *, CASE WHEN o = 'error' THEN 'error' WHEN o = 'refused' AND refused_run >= 3 THEN CASE WHEN widest IS NULL THEN 'throttled_empty' ELSE 'rate_limited' END WHEN o = 'ok' AND cards = 0 THEN 'end_of_results'
                             WHEN is_known AND known_run >= 3 THEN 'known_page' WHEN o = 'ok' AND page >= 5 AND cards < widest THEN 'end_of_results' WHEN o = 'ok' AND page >= 5 THEN 'cap_hit' END AS stop FROM r),
        f AS (SELECT walk, min(n) AS n FROM t WHERE stop IS NOT NULL GROUP BY 1),
        e AS (SELECT g.walk, coalesce(any_value(t.stop), 'stopped') AS stop_reason, coalesce(any_value(t.page), count(*) FILTER (WHERE g.o = 'ok')) AS pages FROM g LEFT JOIN f ON g.walk = f.walk LEFT JOIN t ON t.walk = f.walk AND t.n = f.n GROUP BY 1)
        SELECT stop_reason, count(*) AS walks, CAST(sum(pages) AS BIGINT) AS pages FROM e GROUP BY 1""",
    "page_cards": "SELECT p_partkey, p_name AS title, p_brand AS company, 'https://jobs.example.com/' || p_partkey AS url FROM part",
    "not_seen_before": "SELECT item_id FROM benchmark WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL)",
    "label_backfill": """
        SELECT 'k' || l.doc_id AS posting_key, CASE WHEN toxic = 1 THEN 'not_for_me' ELSE 'golden' END AS label,
               CASE WHEN lang = 'en' THEN d.doc_id WHEN lang IS NULL OR lang <> 'en' OR n_chars < 2000 THEN -d.doc_id END AS job_id FROM labels l LEFT JOIN documents d USING (doc_id)""",
    "agreement_rate": """
        WITH x AS (SELECT toxic = 0 AS clean, CASE WHEN n_chars < 3000 THEN true END AS short, lang = 'en' AS english, CASE WHEN quality = 1 THEN true END AS quality FROM labels JOIN documents USING (doc_id)),
        u AS (SELECT 'short' AS rule, short AS g, clean FROM x UNION ALL SELECT 'english', english, clean FROM x UNION ALL SELECT 'quality', quality, clean FROM x),
        c AS (SELECT rule, count(*) FILTER (WHERE g IS NOT NULL AND clean IS NOT NULL) AS decided, count(*) FILTER (WHERE g = clean) AS agreed, count(*) FILTER (WHERE g IS NULL OR clean IS NULL) AS undecided FROM u GROUP BY 1)
        SELECT *, CAST(agreed AS DOUBLE) / nullif(decided, 0) AS rate, decided >= 100 AND coalesce(CAST(agreed AS DOUBLE) / nullif(decided, 0) > 0.95, false) AS ready FROM c""",
    "due_batches": """
        WITH c AS (SELECT role, turn, conv_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id % 60 AS BIGINT)) AS t FROM conversations),
        n AS (SELECT *, row_number() OVER (PARTITION BY role, turn ORDER BY t, conv_id) - 1 AS n, count(*) OVER (PARTITION BY role, turn) AS a, min(t) OVER (PARTITION BY role, turn) AS oldest FROM c)
        SELECT role, turn, conv_id, n // 8 AS batch, n % 8 AS place FROM n WHERE oldest <= TIMESTAMP '2024-01-01 00:10:00' - INTERVAL 30 MINUTE OR (n // 8 + 1) * 8 <= a""",
    "golden_diff": """
        WITH d AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), b AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM benchmark),
        u AS ((SELECT line, 'left' AS side FROM d EXCEPT ALL SELECT line, 'left' FROM b) UNION ALL (SELECT line, 'right' FROM b EXCEPT ALL SELECT line, 'right' FROM d))
        SELECT line, side, count(*) AS n FROM u GROUP BY 1, 2""",
    "golden_line_diff": """
        WITH d AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), b AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM benchmark),
        l AS (SELECT line, sum(k) AS k FROM (SELECT line, 1 AS k FROM d UNION ALL SELECT line, -1 FROM b) GROUP BY 1)
        SELECT line, CASE WHEN k > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(k) AS BIGINT) AS n FROM l WHERE k <> 0""",
    "feed_cards": """
        SELECT p_partkey, p_name || ' & more' AS title, p_brand AS company, 'IT' AS country_code, TIMESTAMP '2024-02-03 04:05:06' AS posted_at FROM part
        WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0""",
}
