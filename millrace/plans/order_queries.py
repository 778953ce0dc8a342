"""Queries over ``orders``, ``lineitem`` and ``customer`` as postings, sightings and companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import geo
from millrace.functions.timeutil import at, backoff, steps_wait
from millrace.operators import lifecycle, messages, ordered, queueing, requests, resolve, trend
from millrace.plans.tables import POSTINGS, postings, table
from millrace.sources import store

NOW = "1998-06-01 00:00:00"
RANKS = {(t, c): (t - 1) * 3 + c for t in (1, 2, 3) for c in (1, 2, 3)}


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with a tier from the company's nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), (F.col("c_nationkey") % 5 + 1).alias("tier"))
    return postings(spark, sf_dir).join(c, "company", "left")


TIERED = POSTINGS + """, tiered AS (
        SELECT p.*, c.c_nationkey % 5 + 1 AS tier FROM postings p LEFT JOIN customer c ON p.company = c.c_custkey
    )"""


def stage_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).groupBy("status", "class").agg(F.count("*").alias("n"), F.min("first_seen").alias("oldest"))


def expiry_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).withColumns({"refused": F.when(F.col("id") % 7 == 0, F.col("first_seen")), "posted": F.when(F.col("id") % 3 == 0, F.col("first_seen") - F.expr("INTERVAL 20 DAYS"))})
    rules = lifecycle.expiry_rules(at(NOW), "first_seen", "refused", "posted", F.col("class") >= 4)
    return p.select(F.coalesce(F.when(F.col("status") != "P", lifecycle.first_match(rules)), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def age_out_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("tier").isin(2, 3) & (F.col("class") >= 3) & (F.col("status") == "O")
    return tiered(spark, sf_dir).filter(hit).groupBy("tier", "class").agg(F.count("*").alias("n"))


def value_pick_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = tiered(spark, sf_dir).filter("status = 'O'")
    return queueing.value_pick(waiting, queueing.value_rank(RANKS, F.col("tier"), F.col("class")), 100).select("id", "tier", "class", "value_rank", "first_seen")


def head_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).filter("tier is not null")
    clocks = t.filter("status = 'F' AND tier < 5").groupBy("tier").agg(F.max("first_seen").alias("turn_at"))
    return queueing.head_tier(t.filter("status = 'O' AND tier < 5"), clocks)


def floor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = tiered(spark, sf_dir).filter("status = 'O'").withColumn("covered", F.when(F.col("class") == 5, None).otherwise(F.col("class") >= 3))
    return queueing.floor_pick(waiting, at(NOW), F.col("covered"), 50).select("id", "tier", "class", "first_seen")


def quota_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.quota_schedule(tiered(spark, sf_dir), "company", ["first_seen", "id"], 8).select("id", "company", "pick", "is_floor")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the location and the country of their nation."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Plant, "), F.initcap("n_name")).alias("location"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    return c.select("c_custkey", "location", geo.country_of(F.col("location")).alias("country"))


def tier_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = (F.col("c_custkey") % 4 + 1).cast("int")
    c = _placed(spark, sf_dir).withColumn("tier", geo.provisional_tier(F.col("country"), hint))
    return c.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("country").isNull()).alias("hinted"))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _placed(spark, sf_dir).filter(geo.in_scope(F.col("location"), ["france", "germany"]))
    return kept.groupBy("location").agg(F.count("*").alias("n"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("seen_at"), F.col("l_linenumber").alias("line"))


def twin_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.twin_candidates(postings(spark, sf_dir), _sightings(spark, sf_dir), ["company", "class"])


def crowded_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.crowded_keys(postings(spark, sf_dir), ["company"], 3)


def unique_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unique_twins(resolve.twins_of_unique(postings(spark, sf_dir), _sightings(spark, sf_dir), ["company", "class"]))


def merge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = resolve.mutual_twins(resolve.twins_of_unique(postings(spark, sf_dir), _sightings(spark, sf_dir), ["company", "class"]))
    members = pairs.select(F.col("id").alias("group"), F.explode(F.array("id", "twin")).alias("id"))
    rows = members.join(postings(spark, sf_dir), "id").withColumn("note", F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))))
    stage = F.when(F.col("status") == "F", "scored").when(F.col("status") == "O", "seen").otherwise("described")
    key = resolve.survivor_key(stage, F.col("first_seen"), F.col("note").isNotNull(), F.col("id"))
    return resolve.merge_groups(rows, "group", key, ["first_seen"], ["first_seen"], ["note"])


def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(postings(spark, sf_dir).select("id", "company", "class", "first_seen"), _sightings(spark, sf_dir), ["company", "class"])


def sighting_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.sighting_rollup(_sightings(spark, sf_dir), ["source", "id"], "seen_at", "line")


def also_seen_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.also_seen_on(_sightings(spark, sf_dir), "id", "seen_at", "source")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sightings(spark, sf_dir).join(postings(spark, sf_dir).select("id", "price", "status"), "id")
    return requests.provenance(s, "source", F.col("price") >= 400_000, F.col("status") == "F")


def refreshed_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sightings(spark, sf_dir)
    split = at("1998-01-01 00:00:00")
    old = s.filter(F.col("seen_at") < split).groupBy("source").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("seen_count"))
    return store.refresh_upsert(old, s.filter(F.col("seen_at") >= split).select("source", F.col("seen_at").alias("at")), ["source"])


def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).select("id", "status", "class")
    return store.replace_upsert(p.filter("status <> 'P'"), p.filter("status = 'P' OR class <= 2").withColumn("status", F.lit("N")), ["id"])


def archive_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).withColumn("archived_at", F.when(F.col("id") % 4 == 0, F.col("first_seen")))
    batch = store.archive_batch(p, F.col("status") == "F", ["first_seen", "id"], 500, ["id", "company", "price"])
    children = _sightings(spark, sf_dir).join(batch.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("sightings"))
    return batch.join(children, "id", "left").withColumn("sightings", F.coalesce("sightings", F.lit(0)).cast("long"))


def catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    now = p.filter("status <> 'P'").select("id", (F.col("class") * 6).alias("base"), F.when(F.col("price") < 150_000, F.col("class") * 6).otherwise(40).alias("interval"), (F.col("price") >= 40_000).alias("active"))
    spec = p.filter("status <> 'F'").select("id", (F.col("class") * 6 + F.when(F.col("price") >= 100_000, 6).otherwise(0)).alias("base"))
    return store.sync_catalog(now, spec, ["id"], p)


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).withColumn("day", F.date_trunc("month", F.col("first_seen").cast("timestamp")).cast("date"))
    runs = p.filter("status = 'P'").select("day", F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("commit"), F.col("class").cast("long").alias("tokens"), F.when(F.col("id") % 2 == 0, F.col("class").cast("long")).alias("rate_limits"), F.when(F.col("id") % 5 == 0, F.lit(1).cast("long")).alias("deferred"))
    return trend.daily_metrics(runs, p.filter("status = 'F'").select("day", (F.col("price") >= 400_000).alias("strong")), p.filter("status = 'O' AND class = 1").select("day"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("class")
    wait = backoff(n, 1800, 12 * 3600)
    return postings(spark, sf_dir).select("id", n.alias("attempts"), wait.alias("wait_s"), (F.col("first_seen") + F.make_dt_interval(secs=wait)).alias("next_at"), steps_wait(n, [3600, 21_600, 86_400]).cast("long").alias("package_wait_s"))


def digest_top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).filter("status = 'F' AND tier is not null")
    return messages.digest_sections(t, "tier", [F.desc("price"), "id"], 20, 5, "tier").select("id", "tier", "price", F.col("rank").cast("long").alias("rank"), "shown")


def latest_order_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_of_key(postings(spark, sf_dir), ["company"], F.struct(-F.unix_micros(F.col("first_seen").cast("timestamp")), "id"), ["id", "first_seen"])


def previous_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.shifted(postings(spark, sf_dir).select("id", "company", "first_seen"), "company", ["first_seen", "id"], {"previous_id": F.col("id")}).select("id", "previous_id")


def delivered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = postings(spark, sf_dir), _sightings(spark, sf_dir)
    early = s.join(p.select("id", "first_seen"), "id").filter("seen_at <= first_seen + INTERVAL 40 DAYS").select("id")
    marked = p.join(early.distinct().withColumn("early", F.lit(True)), "id", "left")
    return marked.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.coalesce("early", F.lit(False))).alias("early")).withColumn("share", F.col("early") / F.col("n"))


#: How the simulated queues are served; arrivals are days apart, so the waits are too.
SERVED = queueing.QueueRules(one_in=8, floor_s=60 * 86_400.0, serve_every_s=43_200.0, ranks={(t, c): (t - 1) * 5 + c for t in range(1, 6) for c in range(1, 6)}, aged_classes=(4, 5), aged_tiers=(2, 3), aged_s=400 * 86_400.0, urgent_classes=(1,))


def arrivals_of(postings_with_tier: DataFrame) -> DataFrame:
    """One queue for each tenth company."""
    return postings_with_tier.select(F.floor(F.col("company") / 10).cast("string").alias("host"), "id", F.unix_timestamp(F.col("first_seen").cast("timestamp")).cast("double").alias("t"), F.col("tier").cast("int").alias("tier"), F.col("class").alias("cls"))


def queue_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).filter("status = 'O' AND tier is not null")
    return queueing.simulate(arrivals_of(t), SERVED)


QUERIES = {
    f.__name__: f
    for f in (
        stage_census, expiry_cascade, age_out_dry_run, value_pick_topk, head_tier, floor_pick, quota_schedule, tier_assignment, scope_filter, twin_candidates, crowded_companies, unique_twins, merge_survivors, resolved_entities,
        sighting_rollup, also_seen_on, provenance, refreshed_sightings, replaced_rows, archive_projection, catalog_sync, daily_metrics, retry_schedule, digest_top_sections, latest_order_per_company,
        previous_order, delivered_share, queue_simulation,
    )
}

_TWINS = POSTINGS + """, s AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS source FROM lineitem),
    pairs AS (
        SELECT a.id, b.id AS twin FROM postings a JOIN postings b ON a.company = b.company AND a.class = b.class AND a.id <> b.id
             AND abs(epoch_us(a.first_seen) - epoch_us(b.first_seen)) <= 30 * 86400000000
        WHERE NOT EXISTS (SELECT 1 FROM s x JOIN s y ON x.source = y.source WHERE x.id = a.id AND y.id = b.id)
    ), uniq AS (SELECT id, min(twin) AS twin FROM pairs GROUP BY 1 HAVING count(*) = 1)"""
_SIGHTINGS = "s AS (SELECT l_orderkey AS id, l_suppkey AS source, l_shipdate AS seen_at, l_linenumber AS line FROM lineitem)"
_RANK = "CASE WHEN tier BETWEEN 1 AND 3 AND class BETWEEN 1 AND 3 THEN (tier - 1) * 3 + class ELSE 99 END"

ORACLES = {
    "stage_census": f"WITH {POSTINGS} SELECT status, class, count(*) AS n, min(first_seen) AS oldest FROM postings GROUP BY 1, 2",
    "expiry_cascade": f"""
        WITH {POSTINGS}, x AS (SELECT *, CASE WHEN id % 7 = 0 THEN first_seen END AS refused, CASE WHEN id % 3 = 0 THEN first_seen - INTERVAL 20 DAY END AS posted FROM postings)
        SELECT coalesce(CASE WHEN status <> 'P' THEN CASE
                   WHEN refused < TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'description_refused' WHEN posted < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'posting_too_old'
                   WHEN first_seen < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'waited_too_long' WHEN class >= 4 AND first_seen < TIMESTAMP '{NOW}' - INTERVAL 96 HOUR THEN 'aged_out' END END, 'kept') AS reason,
               count(*) AS n FROM x GROUP BY 1""",
    "age_out_dry_run": f"WITH {TIERED} SELECT tier, class, count(*) AS n FROM tiered WHERE tier IN (2, 3) AND class >= 3 AND status = 'O' GROUP BY 1, 2",
    "value_pick_topk": f"WITH {TIERED} SELECT id, tier, class, {_RANK} AS value_rank, first_seen FROM tiered WHERE status = 'O' ORDER BY value_rank, first_seen NULLS LAST, id LIMIT 100",
    "head_tier": f"""
        WITH {TIERED}, w AS (SELECT DISTINCT tier FROM tiered WHERE status = 'O' AND tier < 5), c AS (SELECT tier, max(first_seen) AS turn_at FROM tiered WHERE status = 'F' AND tier < 5 GROUP BY 1)
        SELECT tier, turn_at FROM w LEFT JOIN c USING (tier) ORDER BY turn_at NULLS FIRST, tier LIMIT 1""",
    "floor_pick": f"""
        WITH {TIERED} SELECT id, tier, class, first_seen FROM tiered
        WHERE status = 'O' AND first_seen < TIMESTAMP '{NOW}' AND NOT coalesce(CASE WHEN class = 5 THEN NULL ELSE class >= 3 END, false) ORDER BY first_seen, id LIMIT 50""",
    "quota_schedule": f"""
        WITH {POSTINGS}, n AS (SELECT id, company, row_number() OVER (PARTITION BY company ORDER BY first_seen, id) - 1 AS pick FROM postings)
        SELECT id, company, pick, pick % 8 = 0 AS is_floor FROM n""",
    "tier_assignment": """
        WITH c AS (SELECT c_custkey, CASE WHEN n_name IN ('FRANCE', 'GERMANY', 'ROMANIA') THEN 3 WHEN n_name = 'UNITED KINGDOM' THEN 4 WHEN n_name IN ('UNITED STATES', 'CANADA', 'INDIA', 'RUSSIA') THEN NULL ELSE c_custkey % 4 + 1 END AS tier,
                          n_name IS NULL OR n_name NOT IN ('FRANCE', 'GERMANY', 'ROMANIA', 'UNITED KINGDOM', 'UNITED STATES', 'CANADA', 'INDIA', 'RUSSIA') AS unknown
                   FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
        SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n, count(*) FILTER (WHERE unknown) AS hinted FROM c GROUP BY 1""",
    "scope_filter": """
        SELECT 'Plant, ' || array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS location, count(*) AS n
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NULL OR n_name NOT IN ('ROMANIA', 'UNITED KINGDOM', 'UNITED STATES', 'CANADA', 'INDIA', 'RUSSIA') GROUP BY 1""",
    "crowded_companies": f"""
        WITH {POSTINGS}, b AS (SELECT company, CAST(floor(epoch(first_seen) / 2592000) AS BIGINT) AS block, count(*) AS entities FROM postings GROUP BY 1, 2),
        n AS (SELECT x.company, x.block, x.entities, CAST(x.entities * (sum(y.entities) - 1) AS BIGINT) AS pairs FROM b x JOIN b y ON y.company = x.company AND y.block BETWEEN x.block - 1 AND x.block + 1 GROUP BY 1, 2, 3)
        SELECT * FROM n WHERE pairs > 3""",
    "twin_candidates": f"WITH {_TWINS} SELECT id, twin FROM pairs",
    "unique_twins": f"WITH {_TWINS} SELECT id, twin FROM uniq",
    "merge_survivors": f"""
        WITH {_TWINS}, m AS (SELECT a.id, a.twin FROM uniq a JOIN uniq b ON a.id = b.twin AND a.twin = b.id WHERE a.id < a.twin),
        g AS (SELECT id AS "group", id FROM m UNION ALL SELECT id, twin FROM m),
        r AS (SELECT g."group", p.*, CASE WHEN p.id % 2 = 0 THEN 'n' || p.id END AS note, CASE status WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 4 END AS stage FROM g JOIN postings p USING (id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY -stage, first_seen, note IS NULL, id) AS k FROM r)
        SELECT "group", min(id) FILTER (WHERE k = 1) AS survivor, min(first_seen) AS first_seen, max(first_seen) AS last_first_seen, coalesce(max(note) FILTER (WHERE k = 1), max(note) FILTER (WHERE k = 2)) AS note FROM o GROUP BY 1""",
    "sighting_rollup": f"""
        WITH {_SIGHTINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY seen_at, line) AS k FROM s)
        SELECT source, id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count, min(line) FILTER (WHERE k = 1) AS first_id FROM o GROUP BY 1, 2""",
    "also_seen_on": f"""
        WITH {_SIGHTINGS}, f AS (SELECT id, source, min(seen_at) AS first FROM s GROUP BY 1, 2)
        SELECT id, string_agg(CAST(source AS VARCHAR), ',' ORDER BY first, source) AS sources FROM f GROUP BY 1""",
    "provenance": f"""
        WITH {POSTINGS}, {_SIGHTINGS}, h AS (SELECT source, count(*) AS hits, count(*) FILTER (WHERE status = 'F') AS direct, count(*) FILTER (WHERE price >= 400000) AS strong FROM s JOIN postings USING (id) GROUP BY 1)
        SELECT *, hits >= 5 AND CAST(direct AS DOUBLE) / hits < 0.5 AS suspect FROM h""",
    "refreshed_sightings": f"WITH {_SIGHTINGS} SELECT source, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS seen_count FROM s GROUP BY 1",
    "replaced_rows": f"WITH {POSTINGS} SELECT id, CASE WHEN status = 'P' OR class <= 2 THEN 'N' ELSE status END AS status, class FROM postings",
    "archive_projection": f"""
        WITH {POSTINGS}, b AS (SELECT id, company, price FROM postings WHERE status = 'F' AND id % 4 <> 0 ORDER BY first_seen, id LIMIT 500)
        SELECT id, company, price, (SELECT count(*) FROM lineitem WHERE l_orderkey = b.id) AS sightings FROM b""",
    "catalog_sync": f"""
        WITH {POSTINGS}, t AS (SELECT id, class * 6 AS base, CASE WHEN price < 150000 THEN class * 6 ELSE 40 END AS i, price >= 40000 AS active FROM postings WHERE status <> 'P'),
        p AS (SELECT id, class * 6 + CASE WHEN price >= 100000 THEN 6 ELSE 0 END AS base FROM postings WHERE status <> 'F')
        SELECT coalesce(t.id, p.id) AS id,
               CASE WHEN t.id IS NULL THEN 'added' WHEN p.id IS NULL THEN CASE WHEN active THEN 'deactivated' ELSE 'kept' END WHEN t.base <> p.base OR NOT active THEN 'updated' ELSE 'kept' END AS action,
               CAST(CASE WHEN p.id IS NULL THEN i WHEN t.id IS NULL OR i = t.base THEN p.base ELSE least(i, p.base) END AS INTEGER) AS interval
        FROM t FULL JOIN p ON t.id = p.id""",
    "daily_metrics": f"""
        WITH {POSTINGS}, x AS (SELECT *, CAST(date_trunc('month', first_seen) AS DATE) AS day FROM postings),
        r AS (SELECT day, count(*) AS runs, CAST(sum(class) AS BIGINT) AS tokens, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT 'c' || y.id % 3 AS c FROM x y WHERE y.status = 'P' AND y.day = x.day)) AS commits,
                     CASE WHEN count(*) FILTER (WHERE id % 2 = 0 OR id % 5 = 0) > 0 THEN CAST(coalesce(sum(class) FILTER (WHERE id % 2 = 0), 0) + count(*) FILTER (WHERE id % 5 = 0) AS BIGINT) END AS limits
              FROM x WHERE status = 'P' GROUP BY day),
        o AS (SELECT day, count(*) AS scored, count(*) FILTER (WHERE price >= 400000) AS high FROM x WHERE status = 'F' GROUP BY day),
        k AS (SELECT day, count(*) AS packaged FROM x WHERE status = 'O' AND class = 1 GROUP BY day)
        SELECT day, runs, tokens, commits, limits, coalesce(scored, 0) AS scored, coalesce(high, 0) AS high, coalesce(packaged, 0) AS packaged FROM r FULL JOIN o USING (day) FULL JOIN k USING (day)""",
    "retry_schedule": f"""
        WITH {POSTINGS}, w AS (SELECT id, class AS attempts, least(43200.0, 1800.0 * pow(2, class - 1)) AS w, first_seen FROM postings)
        SELECT id, attempts, CAST(w AS DOUBLE) AS wait_s, first_seen + to_seconds(CAST(w AS BIGINT)) AS next_at, CAST(CASE attempts WHEN 1 THEN 3600 WHEN 2 THEN 21600 WHEN 3 THEN 86400 END AS BIGINT) AS package_wait_s FROM w""",
    "digest_top_sections": f"""
        WITH {TIERED}, t AS (SELECT id, tier, price, row_number() OVER (PARTITION BY tier ORDER BY price DESC, id) AS rank FROM tiered WHERE status = 'F' AND tier IS NOT NULL)
        SELECT *, row_number() OVER (ORDER BY tier, rank) <= 5 AS shown FROM t WHERE rank <= 20""",
    # one step for each posting of a key; what is open has the postings still to come, too
    "resolved_entities": f"""
        WITH RECURSIVE {POSTINGS}, {_SIGHTINGS}, e AS (
            SELECT id, company, class, epoch_us(first_seen) AS t, coalesce(sources, []) AS sources, row_number() OVER (PARTITION BY company, class ORDER BY first_seen, id) AS k
            FROM postings LEFT JOIN (SELECT id, list(DISTINCT source) AS sources FROM s GROUP BY id) USING (id)
        ), walk AS (
            SELECT company, class, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS dropped, CAST(NULL AS BIGINT) AS kept, list(struct_pack(f := id, t := t, sources := sources)) AS open FROM e GROUP BY company, class
            UNION ALL
            SELECT company, class, k, CASE WHEN len(m) = 1 THEN CASE WHEN older THEN m[1].f ELSE id END END, CASE WHEN len(m) = 1 THEN CASE WHEN older THEN id ELSE m[1].f END END,
                   CASE WHEN len(m) = 1 THEN list_append(list_filter(open, lambda c: c.f <> m[1].f AND c.f <> id), struct_pack(f := CASE WHEN older THEN id ELSE m[1].f END, t := least(t, m[1].t), sources := list_concat(m[1].sources, sources)))
                        ELSE open END
            FROM (SELECT *, (t, id) < (m[1].t, m[1].f) AS older FROM (
                SELECT e.*, w.open, CASE WHEN len(list_filter(w.open, lambda c: c.f = e.id)) = 1 THEN list_filter(w.open, lambda c: c.f <> e.id AND abs(e.t - c.t) <= 2592000000000 AND NOT list_has_any(c.sources, e.sources)) ELSE [] END AS m
                FROM walk w JOIN e ON e.company = w.company AND e.class = w.class AND e.k = w.k + 1))
        )
        SELECT id, min(id) OVER (PARTITION BY company, class, coalesce(kept, id)) AS root FROM e LEFT JOIN (SELECT dropped, kept FROM walk WHERE dropped IS NOT NULL) ON dropped = id""",
    "latest_order_per_company": f"WITH {POSTINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY first_seen DESC, id) AS k FROM postings) SELECT company, id, first_seen FROM n WHERE k = 1",
    "previous_order": f"WITH {POSTINGS} SELECT id, lag(id) OVER (PARTITION BY company ORDER BY first_seen, id) AS previous_id FROM postings",
    "delivered_share": f"""
        WITH {POSTINGS}, {_SIGHTINGS}, e AS (SELECT DISTINCT p.id FROM postings p JOIN s USING (id) WHERE seen_at <= first_seen + INTERVAL 40 DAY),
        c AS (SELECT class, count(*) AS n, count(e.id) AS early FROM postings LEFT JOIN e USING (id) GROUP BY 1)
        SELECT *, CAST(early AS DOUBLE) / n AS share FROM c""",
}
