"""Delivery, histories, model stages, settings and registered functions on small rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.register import register_all
from millrace.functions.timeutil import at
from millrace.operators import cv, delivery, history, model_stage, requests
from millrace.sources import config, store

NOW = dt.datetime(2026, 10, 1, 12)


def test_alerts_need_a_stated_verdict_only_where_verified(spark):
    rows = [(1, 1, 9, None, "confirmed"), (2, 1, 9, None, "unconfirmed"), (3, 2, 9, None, "not_stated"), (4, 1, 7, None, "confirmed"), (5, 1, 9, NOW, "confirmed"), (6, 4, 9, None, "confirmed"), (7, 1, 9, None, None), (8, None, 9, None, None)]
    df = spark.createDataFrame(rows, "id int, tier int, score int, alerted_at timestamp_ntz, remote_verdict string")
    assert {r.id for r in delivery.alert_candidates(df, {1: 8, 2: 8}, [1]).collect()} == {1, 3, 7}


def test_packages_wait_after_failures(spark):
    day = NOW.date()
    df = spark.createDataFrame([(i, "scored", day if i != 5 else day - dt.timedelta(days=9), "confirmed", 1, 9) for i in range(6)], "id int, stage string, note_day date, remote_verdict string, tier int, score int")
    failures = spark.createDataFrame([(1, True, None), (2, False, NOW + dt.timedelta(hours=1)), (3, False, NOW - dt.timedelta(hours=1))], "id int, stopped boolean, next_try_at timestamp_ntz")
    done = spark.createDataFrame([(4,)], "id int")
    assert {r.id for r in delivery.package_candidates(df, done, failures, {1: 8}, at(NOW)).collect()} == {0, 3}


def test_letters(spark):
    rows = [("Acme builds. I made 3 tools", "Acme"), ("I am thrilled - really", "Acme"), ("In 2020 I sold " + "x " * 100, "Acme"), ("He did 4", ""), ("", "Acme")]
    out = spark.createDataFrame(rows, "t string, c string").select(delivery.letter_violations(F.col("t"), F.col("c"), voice="he|his|him")).collect()
    assert [r[0] for r in out] == [["opens with the company"], ["banned phrase: thrilled", "dash", "nothing concrete"], ["too long"], ["third person"], ["nothing concrete"]]


def test_notes_and_manifests(spark):
    r = spark.range(1).select(delivery.note_text(F.lit("T"), F.lit("C"), {"a": F.lit(1), "b": F.lit(None)}, F.lit(None)), delivery.manifest({"id": F.lit(7)}, {"cv": F.lit("x")})).first()
    assert r[0] == "---\na: 1\n---\n\n# T at C\n\n\n" and json.loads(r[1])["id"] == 7 and len(json.loads(r[1])["cv_sha256"]) == 64


def test_migration_balances(spark):
    old = spark.createDataFrame([("a", 1, 1, "x"), ("a", 3, 2, "y"), ("a", 3, 1, "z"), ("b", 2, 1, None), (None, 1, 1, "q")], "key string, at int, seq int, v string")
    new = history.migrate(old, "key", "at", "seq", ["v"])
    assert sorted(map(tuple, new.collect())) == [("a", 1, 3, 3, "y"), ("b", 2, 2, 1, None)]
    assert history.balance(old, new, "key").first().balanced and not history.balance(old, new.limit(1), "key").first().balanced
    assert history.balance(old.limit(0), new.limit(0), "key").first().balanced


def test_comparison(spark):
    stored = spark.createDataFrame([(i, "ok", 5) for i in range(100)], "id int, verdict string, score int")
    assert history.compare(stored, stored).first().adopt
    worse = stored.withColumn("score", F.col("score") + F.when(F.col("id") < 11, 2).otherwise(1))
    assert not history.compare(stored, worse).first().adopt
    assert history.compare(stored.limit(0), stored).first().adopt is False


def test_turns(spark):
    kinds = ["search", "description", "description", "description", "search", "packaging", "search"]
    log = spark.createDataFrame([("h", NOW + dt.timedelta(seconds=k), k, x) for k, x in enumerate(kinds)], "host string, at timestamp_ntz, n int, kind string")
    out = [(r.description_run, r.gives_way) for r in history.fresh_turns(log, "host", ["n"], 2).orderBy("n").collect()]
    assert out == [(0, False), (0, False), (1, False), (2, True), (3, False), (0, False), (0, True)]


def test_failover_leaves_unanswered_rows_due(spark):
    rows = spark.createDataFrame([(i, f"text {i} spark") for i in range(9)], "id int, text string")
    ask = lambda keep: lambda df: df.filter(keep).select("id", model_stage.keyword_score("text", {"spark": 4}).alias("answer"))
    out = {r.id: (r.provider, r.answer) for r in model_stage.with_failover(rows, ["id"], {"a": ask("id % 3 = 0"), "b": ask("id % 2 = 0")}).collect()}
    assert out == {0: ("a", 5), 3: ("a", 5), 6: ("a", 5), 2: ("b", 5), 4: ("b", 5), 8: ("b", 5)}


def test_statuses(spark):
    df = spark.createDataFrame([(200,), (400,), (429,), (999,), (503,), (403,), (None,)], "s int")
    assert [r[0] for r in df.select(requests.status_kind(F.col("s"))).collect()] == ["clean", "end", "throttled", "throttled", "transient", "failed", "transient"]


def test_patched_maps_and_clocks(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, None)], "m map<string,string>, p map<string,string>")
    assert [r[0] for r in df.select(store.patched(F.col("m"), F.col("p"), ["a"])).collect()] == [{"b": "3", "c": "4"}, {}]
    state = spark.createDataFrame([(1, NOW, 4)], "tier int, turn_at timestamp_ntz, picks_done long")
    picks = spark.createDataFrame([(1, NOW + dt.timedelta(hours=1)), (2, NOW)], "tier int, at timestamp_ntz")
    assert {r.tier: r.picks_done for r in store.turn_clocks(state, picks).collect()} == {1: 5, 2: 1}


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"tiers": {"1": {"threshold": 7, "verifies": true}}, "keywords": ["C++"]}')
    s = config.settings(str(path))
    assert s.tiers[1].threshold == 7.0 and s.tiers[1].verifies and s.quota_one_in == 4
    for bad in ('{"tiers": {}, "x": 1}', "{}", '{"tiers": {"1": {"threshold": "7"}}}', '{"tiers": {}, "quota_one_in": true}', "[]"):
        path.write_text(bad)
        with pytest.raises(ValueError, match="settings"):
            config.settings(str(path))


def test_registered_functions(spark):
    names = register_all(spark)
    assert spark.sql(f"SELECT {names[0]}('Ré')").first()[0] == "Re"
    assert spark.sql("SELECT mr_work_mode('This is a fully remote role.' || repeat(' We build software.', 20), '', '', NULL).verdict").first()[0] == "confirmed"


def test_cvs_as_lines(spark):
    text = "Jo Miller\n\n## Summary\nBakes.\n## Experience\n**Baker, Mill Co**\n  **: night shift**\n- Built an oven\n- Improve bread\n\n**Miller**\n- Ground 3 t of flour\n## Skills\n**Tools:** sieve\n- stray\n- lp.oven :: I built an oven."
    lines = cv.cv_lines(spark.createDataFrame([("m", text), ("n", None)], "id string, text string"), "id", "text")
    got = [(r.section, r.role, r.kind, r.content) for r in lines.orderBy("line").collect()]
    assert got[0] == (None, None, "text", "Jo Miller") and ("Experience", "Baker, Mill Co", "bullet", "Built an oven") in got
    assert ("Experience", "Miller", "bullet", "Ground 3 t of flour") in got and ("Skills", None, "bullet", "stray") in got and ("Skills", None, "proof", "lp.oven :: I built an oven.") in got
    assert {r.role: r.chars for r in cv.budgets(lines, "id").collect()} == {"Baker, Mill Co": [13, 13], "Miller": [19]}
    tailored = lines.withColumn("content", F.when(F.col("content") == "Improve bread", "Improved bread").otherwise(F.col("content")))
    assert [tuple(r) for r in cv.changed_bullets(tailored, lines, "id").collect()] == [("m", "Improved bread")]
    need = spark.createDataFrame([("m", "3 t"), ("m", "40 %"), ("x", "1")], "id string, metric string")
    assert {tuple(r) for r in cv.missing_metrics(tailored, need, "id").collect()} == {("m", "40 %"), ("x", "1")}
