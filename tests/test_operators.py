"""Operators on small invented rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions.timeutil import at
from millrace.operators import lifecycle, messages, queueing, requests, resolve
from millrace.sources import feeds, pages, store

NOW = dt.datetime(2026, 10, 1, 12)


def test_codes_and_accounting(spark):
    log = spark.createDataFrame([("a", NOW, 403, "neutral"), ("a", NOW, None, "ok"), ("a", NOW, None, "neutral"), *(("b", NOW, s, "error") for s in (503, 200, 429, None, 503))], "source string, at timestamp_ntz, status int, outcome string")
    found = {r.source: r for r in requests.daily_requests(log, "2026-10-01", "2026-10-02", "Europe/Rome", log).filter("sent > 0").collect()}
    assert (found["a"].sent, found["a"].ok, found["a"].refused, found["a"].errors, found["a"].codes) == (3, 1, 1, 1, "403:1 nocode:1 none:1")
    assert found["b"].codes == "200:1 429:1 503:2 none:1"
    assert requests.daily_requests(log, "2026-10-01", "2026-10-02", "Europe/Rome", log).count() == 4


def test_expiry_order(spark):
    old = NOW - dt.timedelta(days=40)
    df = spark.createDataFrame([("seen", "", old, old, old), ("seen", "", old, None, old), ("seen", "", old, None, None), ("seen", "", NOW, None, None), ("scored", "x", old, old, old)], "stage string, stage_reason string, first_seen timestamp_ntz, first_refused_at timestamp_ntz, posted_at timestamp_ntz")
    out = lifecycle.expire(df, lifecycle.expiry_rules(at(NOW)), F.col("stage") == "seen").collect()
    assert [(r.stage, r.stage_reason) for r in out] == [("expired", "description_refused"), ("expired", "posting_too_old"), ("expired", "waited_too_long"), ("seen", ""), ("scored", "x")]


def test_cheap_checks(spark):
    rows = [("u1", "Java Developer", "Milano, Italy", None, None, False), ("u2", "Chef", "Basel Metropolitan Area", 2, "de", True), ("u3", "Chef", "Austin, TX", 4, None, False), ("u4", "Chef", "Berlin, Germany", 1, None, True)]
    df = spark.createDataFrame(rows, "url string, title string, location string, tier_hint int, language string, described boolean")
    seen = spark.sql("SELECT md5('u4') AS link_hash")
    out = {r.url: (r.stage, r.stage_reason, r.tier) for r in lifecycle.cheap_checks(df, seen, ["Java"], ["en"]).collect()}
    assert out == {"u1": ("filtered_out", "title_prefilter:Java", 1), "u2": ("filtered_out", "language:de", 2), "u3": ("filtered_out", "out_of_scope", None), "u4": ("filtered_out", "seen_before_cutover", 3)}


def test_twins(spark):
    d = lambda n: NOW + dt.timedelta(days=n)
    entities = spark.createDataFrame([(1, "acme", d(0)), (2, "acme", d(5)), (3, "beta", d(0)), (4, "beta", d(40)), (5, "", d(0)), (6, "", d(0)), (7, "gamma", d(0)), (8, "gamma", d(1)), (9, "gamma", d(2)), (10, "delta", d(0)), (11, "delta", d(1))], "id long, company string, first_seen timestamp_ntz")
    sightings = spark.createDataFrame([(i, f"s{i}") for i in range(1, 10)] + [(10, "x"), (11, "x")], "id long, source string")
    pairs = resolve.twin_candidates(entities, sightings, ["company"])
    assert {(r.id, r.twin) for r in pairs.collect()} == {(1, 2), (2, 1), (7, 8), (8, 7), (7, 9), (9, 7), (8, 9), (9, 8)}
    assert {(r.id, r.twin) for r in resolve.unique_twins(pairs).collect()} == {(1, 2), (2, 1)}
    roots = {r.id: r.root for r in resolve.resolve(entities, sightings, ["company"]).collect()}
    assert roots[2] == 1 and roots[8] == 8 and roots[11] == 11


def test_upserts(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    news = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted(map(tuple, store.replace_upsert(state, news, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    several = spark.createDataFrame([(2, "B", 1), (3, "D", 2), (3, "C", 1), (3, "E", 3)], "k long, v string, n int").repartition(3)
    assert sorted(map(tuple, store.ignore_upsert(state, several, ["k"], ["n"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_swap(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        store.current(spark, path)
    store.swap(spark.range(3), path)
    before = store.current(spark, path)
    for n in (5, 7):
        store.swap(spark.range(n), path)
        assert store.current(spark, path).count() == n
    # one state before the last is kept for those who read it
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2 and before.columns == ["id"]


def test_a_failed_swap_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    store.swap(spark.range(3), path)
    broken = spark.range(9).select(F.expr("raise_error('no')").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.swap(broken, path)
    assert store.current(spark, path).count() == 3


def test_catalog_rejects_unknown_keys(spark):
    table = spark.createDataFrame([(1, 6, 6, True)], "k int, base int, interval int, active boolean")
    spec = spark.createDataFrame([(1, 6), (9, 6)], "k int, base int")
    with pytest.raises(ValueError, match="9"):
        store.sync_catalog(table, spec, ["k"], spark.createDataFrame([(1,)], "k int"))
    assert store.sync_catalog(table, spec, ["k"], spec).count() == 2


def test_retry_queue(spark):
    now = at(NOW)
    before = spark.createDataFrame([("a", NOW - dt.timedelta(days=2))], "link string, queued_at timestamp_ntz")
    failed = spark.createDataFrame([("a", "scoring"), ("b", "throttled")], "link string, kind string")
    queue = store.deferred_queue(before, failed, now)
    assert {r.link: r.queued_at for r in queue.collect()} == {"a": NOW - dt.timedelta(days=2), "b": NOW}
    old = spark.createDataFrame([("c", "scoring", NOW - dt.timedelta(days=3)), ("d", "throttled", NOW - dt.timedelta(hours=30))], "link string, kind string, queued_at timestamp_ntz")
    live = store.live_deferred(queue.select("link", "kind", "queued_at").unionByName(old), now)
    assert {r.link for r in live.collect()} == {"a", "b", "d"}


def test_due_batches_wait_for_a_full_one(spark):
    rows = [("a", i, NOW) for i in range(5)] + [("b", i, NOW - dt.timedelta(hours=1)) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, id long, stage_changed_at timestamp_ntz")
    out = queueing.due_batches(df, 2, at(NOW), 1800, ["key"], ["id"]).collect()
    assert sorted((r.key, r.id) for r in out) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]


def test_numbers_in_order_are_those_of_a_window(spark):
    random.seed(1)
    rows = [(random.choice(["a", "a", "a", None]), random.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, t int, id long").repartition(5)
    got = {r.id: r.n for r in queueing.numbered_in_order(df, ["key"], ["t", "id"]).collect()}
    place = {}
    for key, _, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        assert got[i] == place.setdefault(key, 0)
        place[key] += 1


def served_plainly(rows, rules):
    """One queue by scans over a list: (id, waited, kind) of what leaves it."""
    left, waiting, turns, picks, out = sorted(rows), [], {}, {}, []
    clock = left[0][0] if left else 0.0
    while left or waiting:
        if not waiting and left[0][0] > clock:
            while clock < left[0][0]:
                clock += rules.serve_every_s
        while left and left[0][0] <= clock:
            waiting.append(left.pop(0))
        aged = [r for r in waiting if rules.aged(r[2], r[3])]
        if aged and clock - min(aged)[0] > rules.aged_s:
            row, kind = min(aged), "aged_out"
        else:
            head = min({r[2] for r in waiting}, key=lambda t: (turns.get(t, float("-inf")), t))
            old = [r for r in waiting if not rules.aged(r[2], r[3])]
            urgent = [r for r in waiting if r[2] == head and r[3] in rules.urgent_classes]
            if picks.get(head, 0) % rules.one_in == 0 and old and clock - min(old)[0] > rules.floor_s:
                row, kind = min(old), "floor"
            elif urgent:
                row, kind = min(urgent), "urgent"
            else:
                row, kind = min(waiting, key=lambda r: (rules.ranks.get((r[2], r[3]), 99), r[0], r[1])), "value"
            turns[row[2]] = clock
            if kind == "floor":
                turns[head] = clock
            picks[head] = picks.get(head, 0) + 1
        waiting.remove(row)
        out.append((row[1], clock - row[0], kind))
        clock += 0 if kind == "aged_out" else rules.serve_every_s
    return out


def test_simulation_agrees_with_scans(spark):
    random.seed(4)
    rules = queueing.QueueRules(3, 5000.0, 600.0, {(t, c): t + c for t in (1, 2, 3) for c in (1, 2, 3)}, (3, 4), (1, 2), 30_000.0, (1,))
    rows = []
    for host, every in (("busy", 500), ("calm", 2000), (None, 550)):
        t = 0.0
        for _ in range(500):
            t += random.randint(0, 2 * every)
            rows.append((host, t, len(rows), random.randint(1, 4), random.randint(1, 4)))
    df = spark.createDataFrame(rows, "host string, t double, id long, tier int, cls int").repartition(4)
    got = {}
    for r in queueing.simulate(df, rules).collect():
        got.setdefault(r.host, []).append((r.id, r.waited_s, r.kind))
    for host in ("busy", "calm", None):
        assert got[host] == served_plainly([r[1:] for r in rows if r[0] == host], rules)
    assert {k for x in got.values() for _, _, k in x} == {"floor", "urgent", "value", "aged_out"}


def test_valuable_rows_wait_less_than_a_day(spark):
    """Twelve days, more arrivals than picks: the valuable go soon, the others in bounded time."""
    random.seed(9)
    rows, t = [], 0.0
    while t < 12 * 86_400:
        t += random.randint(1200, 3600)
        rows.append(("h", t, len(rows), 1, 1 if random.random() < 0.3 else 4))
    df = spark.createDataFrame(rows, "host string, t double, id long, tier int, cls int")
    out = queueing.simulate(df, queueing.QueueRules(ranks={(1, 1): 1, (1, 4): 9}, aged_classes=(4,), aged_tiers=(1,))).collect()
    waited = {i: r.waited_s for r in out for i in [r.id]}
    high = sorted(waited[i] for _, _, i, _, c in rows if c == 1)
    assert high[int(0.9 * len(high))] < 86_400 and high[-1] < 4 * 86_400
    assert max(waited[i] for _, _, i, _, c in rows if c == 4) < 8 * 86_400


def test_percentiles_of_odd_values(spark):
    import numpy as np

    from millrace.operators import calls

    random.seed(2)
    values = {"a": [random.gauss(0, 1000) for _ in range(999)], "b": [7.0] * 50, "c": [1.0], "d": [-5.0, 5.0, None], None: [0.0, 1e300]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("e", None)], "k string, v double").repartition(4)
    got = {r.k: r for r in calls.percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        want = np.percentile([v for v in vs if v is not None], [0, 50, 95, 100])
        assert [got[k].p0, got[k].p50, got[k].p95, got[k].p100] == pytest.approx(want.tolist())


def test_limit_use_counts_up_to_the_limit(spark):
    from millrace.operators import calls

    rows = [(k, NOW + dt.timedelta(minutes=17 * i), i, 1 + i % 5) for k in ("a", "b") for i in range(80 if k == "a" else 3)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, i long, tokens long").repartition(3)
    got = {r.k: r for r in calls.limit_use(df, ["k"], 100, order=["at", "i"]).collect()}
    total = within = 0
    for _, _, _, n in rows[:80]:
        total += n
        within += total <= 100
    assert (got["a"].requests, got["a"].tokens, got["a"].within) == (80, total, within) and (got["b"].requests, got["b"].within) == (3, 3)


def test_unique_twins_from_counts_are_those_from_pairs(spark):
    random.seed(3)
    rows = [(i, random.choice("abcdefgh" + "h" * 20), NOW + dt.timedelta(days=random.randint(0, 400))) for i in range(300)]
    sightings = [(i, random.randint(0, 3)) for i in range(300) for _ in range(random.randint(0, 3))]
    entities = spark.createDataFrame(rows, "id long, company string, first_seen timestamp_ntz")
    seen = spark.createDataFrame(sightings, "id long, source int")
    want = resolve.unique_twins(resolve.twin_candidates(entities, seen, ["company"]))
    got = resolve.unique_twins(resolve.twins_of_unique(entities, seen, ["company"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    assert resolve.possibly_unique(entities, seen, ["company"]).count() < 250


def test_only_entities_with_another_near_them_are_looked_at(spark):
    days = {1: ("a", 0), 2: ("a", 31), 3: ("a", 200), 4: ("b", 0), 5: ("c", 5), 6: ("c", 6)}
    entities = spark.createDataFrame([(k, c, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for k, (c, d) in days.items()], "id long, company string, first_seen timestamp_ntz")
    own = resolve._accompanied(resolve._keyed(entities, ["company"], "first_seen", 30 * 86_400), ["company"])
    assert sorted(r.id for r in own.collect()) == [1, 2, 5, 6]


def plain_turns(rows, sightings):
    """Entities (id, company, first_seen) by a scan of all that are left, at each turn."""
    sources = {}
    for i, s in sightings:
        sources.setdefault(i, set()).add(s)
    left, group = {i: (c, t, frozenset(sources.get(i, ()))) for i, c, t in rows}, {i: [i] for i, *_ in rows}
    for own, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if own not in left or not c:
            continue
        twins = [i for i, (c2, t2, s2) in left.items() if i != own and c2 == c and abs(t2 - t) <= dt.timedelta(days=30) and not s2 & left[own][2]]
        if len(twins) == 1:
            kept, dropped = sorted((own, twins[0]), key=lambda i: (left[i][1], i))
            left[kept] = (c, left[kept][1], left[kept][2] | left.pop(dropped)[2])
            group[kept] += group.pop(dropped)
    return {i: min(g) for g in group.values() for i in g}


@pytest.mark.parametrize(("seed", "days", "sources"), [(3, 400, 3), (4, 2000, 3), (5, 900, 1), (6, 4000, 6), (7, 700, 2)])
def test_resolve_gives_every_entity_its_turn(spark, seed, days, sources):
    random.seed(seed)
    rows = [(i, random.choice(["", "a", "b", "c", "h", "h", "h"]), NOW + dt.timedelta(days=random.randint(0, days))) for i in random.sample(range(1000), 300)]
    sightings = [(i, random.randint(0, sources)) for i, *_ in rows for _ in range(random.randint(0, 2))]
    entities = spark.createDataFrame(rows, "id long, company string, first_seen timestamp_ntz").repartition(5)
    found = resolve.resolve(entities, spark.createDataFrame(sightings, "id long, source int"), ["company"]).collect()
    want = plain_turns(rows, sightings)
    assert {r.id: r.root for r in found} == want and len(found) == 300
    assert len(set(want.values())) < 300


def test_resolve_of_a_long_chain(spark):
    # each has one twin, the next: they merge two by two
    rows = [(k, "a", NOW + dt.timedelta(days=20 * k)) for k in range(200)]
    sightings = [(k, f"s{k % 5}") for k in range(200)]
    found = resolve.resolve(spark.createDataFrame(rows, "id long, company string, first_seen timestamp_ntz"), spark.createDataFrame(sightings, "id long, source string"), ["company"])
    assert {r.id: r.root for r in found.collect()} == plain_turns(rows, sightings)


def test_head_tier_prefers_the_never_served(spark):
    waiting = spark.createDataFrame([(1,), (2,), (3,)], "tier int")
    clocks = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(days=1))], "tier int, turn_at timestamp_ntz")
    assert queueing.head_tier(waiting, clocks).first().tier == 3
    assert queueing.head_tier(waiting.filter("tier < 3"), clocks).first().tier == 2


def test_walk_stops(spark):
    def walk(name, pages, cap=None):
        return [(name, k, c, known, o, cap) for k, (c, known, o) in enumerate(pages)]

    rows = (
        walk("known", [(25, 25, "ok")] * 4) + walk("end", [(25, 0, "ok"), (0, 0, "ok")]) + walk("cap", [(25, 0, "ok")] * 6) + walk("area", [(25, 0, "ok")] * 3, 2)
        + walk("limited", [(25, 0, "ok"), *[(0, 0, "refused")] * 3]) + walk("empty", [(0, 0, "refused")] * 3) + walk("error", [(25, 0, "ok"), (0, 0, "error")]) + walk("stopped", [(25, 0, "ok")])
    )
    df = spark.createDataFrame(rows, "walk string, n int, cards int, known int, outcome string, area_cap int")
    stops = feeds.walk_stops(df, 5)
    plan = stops._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") >= 1 and "Join" not in plan and len(set(re.findall(r"\], \[walk[^]]*\], \[[^]]*\]", plan))) == 1  # one order for all windows
    out = {r.walk: (r.stop_reason, r.pages) for r in stops.collect()}
    assert out == {"known": ("known_page", 3), "end": ("end_of_results", 2), "cap": ("cap_hit", 5), "area": ("area_cap", 2), "limited": ("rate_limited", 1), "empty": ("throttled_empty", 0), "error": ("error", 1), "stopped": ("stopped", 1)}


def test_feeds(spark):
    one = spark.createDataFrame([('{"public_slug":"a","url":"u","title":"T &amp; <b>x</b>","company":"C","countries":["IT"],"posted_at":"2026-10-14T11:45:30Z"}',), ('{"public_slug":"b","url":"u","title":"T","company":"C","closed_at":"x"}',), ("[1]",), ('{"public_slug":',), (None,)], "json string")
    assert [(r.job_id, r.title) for r in feeds.first_feed(one).collect()] == [("a", "T & x")]
    two = spark.createDataFrame([(f'{{"guid":"{g}","title":"T","companyName":"C","applicationLink":"u","pubDate":{p},"expiryDate":{e},"locationRestrictions":{loc}}}',) for g, p, e, loc in (("a", 1791978330, 1999999999, "[]"), ("b", 1, 2, "[]"), ("c", '"soon"', "null", '["Italy"]'), ("d", 1, "null", '["Peru"]'))], "json string")
    out = {r.job_id: r.posted_at for r in feeds.second_feed(two, F.lit("2026-10-14 00:00:00").cast("timestamp"), ["Italy"], [1.0]).select("job_id", F.col("posted_at").cast("string")).collect()}
    assert out == {"a": "2026-10-14 11:45:30", "c": None}


def test_pages():
    page = '<ul><li><div data-entity-urn="urn:x:77"><a class="base-card__full-link" href="https://x/77"></a><h3 class="base-search-card__title"> A \0 B </h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4><span class="job-search-card__location">Rome</span><time datetime="2026-01-02"></time></div></li><li>no card</li></ul>'
    assert pages.parse_cards(page) == [{"job_id": "77", "url": "https://x/77", "title": "A B", "company": "Acme", "location": "Rome", "posted_at": "2026-01-02"}]
    assert pages.describe('<div class="show-more-less-html__markup">Hi <b>you</b><br>there</div><span class="posted-time-ago__text x">2 days ago</span>') == ("Hi you there", "ok", "2 days ago")
    assert pages.describe('<meta name="description" content="short text">') == ("short text", "partial", None)
    assert pages.describe("<p>tiny</p><p>" + "long " * 20 + "</p>")[0].startswith("long long")
    assert pages.describe("", "T", "C") == ("T at C", "partial", None)


def test_messages():
    assert messages.pack_blocks(["a" * 10, "b" * 10, "c" * 30], 25) == ["a" * 10 + "\n\n" + "b" * 10, "c" * 25, "c" * 5]
    assert messages.split_oversized("aa\nbb\ncc", 5) == ["aa\nbb", "cc"]


def test_long_blocks_are_cut_in_one_pass():
    lines = ["x" * 90] * 20_000
    parts = messages.split_oversized("\n".join(lines), 4096)
    assert max(map(len, parts)) <= 4096 and "\n".join(parts) == "\n".join(lines)
    assert messages.split_oversized("y" * 10_000, 4096) == ["y" * 4096, "y" * 4096, "y" * 1808]


def test_message_sizes_agree_with_packing(spark):
    random.seed(2)
    rows = [("k", n, "\n".join("x" * random.randint(0, 60) for _ in range(random.randint(1, 6)))) for n in range(40)]
    out = messages.message_sizes(spark.createDataFrame(rows, "key string, n int, text string"), "key", "n", "text", 100).orderBy("message").collect()
    assert [r.chars for r in out] == [len(m) for m in messages.pack_blocks([t for _, _, t in rows], 100)]


def test_digest_budget(spark):
    df = spark.createDataFrame([Row(section=s, score=k, id=s * 100 + k) for s in (1, 2) for k in range(30)])
    out = messages.digest_sections(df, "section", [F.desc("score")], 20, 25, "section").collect()
    assert len(out) == 40 and sum(r.shown for r in out) == 25


def test_line_diff_sees_every_line(spark):
    left = spark.createDataFrame([("same start\nb",), ("x\nx",), (None,)], "text string")
    right = spark.createDataFrame([("same start\nc",), ("x",)], "text string")
    assert {tuple(r) for r in messages.line_diff(left, right).collect()} == {("b", "left", 1), ("c", "right", 1), ("x", "left", 1), ("", "left", 1)}


def test_crowded_keys_are_told_from_counts(spark):
    rows = [(k, "h" if k < 40 else "", NOW + dt.timedelta(days=k % 4)) for k in range(50)] + [(100, "a", NOW), (101, "a", NOW + dt.timedelta(days=29)), (102, None, NOW)]
    entities = spark.createDataFrame(rows, "id long, company string, first_seen timestamp_ntz")
    none = spark.createDataFrame([], "id long, source string")
    pairs = resolve.twin_candidates(entities, none, ["company"]).count()
    found = resolve.crowded_keys(entities, ["company"], 100).collect()
    assert {r.company for r in found} == {"h"} and sum(r.pairs for r in found) + 2 >= pairs >= 40 * 39
    assert not resolve.crowded_keys(entities, ["company"], 10_000).collect()
