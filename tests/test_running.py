"""Budgets, sendings, audits, assembled documents, languages, ranks and registered functions on small rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import languages, text
from millrace.functions.register import register_all
from millrace.operators import calls, cv, delivery, model_stage, queueing, trend
from millrace.operators.queueing import TitleClass
from millrace.sources import pages, text_files

NOW = dt.datetime(2024, 5, 1)


def test_running_gates_against_a_loop(spark):
    random.seed(4)
    rows = [(k, random.choice("ab"), NOW + dt.timedelta(seconds=random.randint(0, 900)), random.choice(["s", "t", None]), random.choice([None, 5, 20])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, day string, at timestamp_ntz, stage string, tokens long").repartition(5)
    got = {r.id: r for r in calls.running_gates(df, ["day"], ["at", "id"], 120, 1500, 60, 90, "s", 0.3).collect()}
    assert len(got) == 400
    for day in "ab":
        own = sorted((r for r in rows if r[1] == day), key=lambda r: (r[2], r[0]))
        n = s = t = 0
        for i, _, when, stage, tokens in own:
            window = sum(x[4] or 0 for x in own if when - dt.timedelta(seconds=60) <= x[2] <= when) - (tokens or 0)
            r = got[i]
            assert (r.requests_before, r.stage_before, r.tokens_before, r.window_before) == (n, s, t, window)
            assert r.may_call == (n < 120 and t < 1500 and window + (tokens or 0) <= 90 and (stage != "s" or s < 36))
            n, s, t = n + 1, s + (stage == "s"), t + (tokens or 0)


def test_degraded_runs(spark):
    rows = [("r1", b, ok) for b, ok in ((1, True), (1, False), (2, False), (2, False), (3, True), (4, True), (5, True))] + [("r2", 1, True)]
    got = calls.degraded_runs(spark.createDataFrame(rows, "run string, batch int, ok boolean"), ["run"], ["batch"], F.col("ok")).collect()
    assert sorted(map(tuple, got)) == [("r1", 5, 1, True), ("r2", 1, 0, False)]


def test_a_provider_s_share_of_a_day(spark):
    rows = spark.createDataFrame([(k, k % 2, k) for k in range(40)], "id long, day int, at int").repartition(4)
    ask = lambda keep: lambda df: df.filter(keep).select("id", F.lit("x").alias("answer"))
    told = model_stage.with_failover(rows, ["id"], {"a": ask("id < 30"), "b": ask("id % 4 <> 3")}, {"a": 5}, ["at", "id"], ["day"])
    assert {r.id: r.provider for r in told.collect()} == {k: "a" if k < 10 else "b" for k in range(40) if k < 10 or k % 4 != 3}
    state = model_stage.stage_state(rows.withColumn("batch", F.col("id")), told, ["id"], ["batch"], ["day"], 0.3).collect()
    assert sorted(map(tuple, state)) == [(0, 20, 0, False), (1, 20, 8, True)]
    nobody = model_stage.with_failover(rows, ["id"], {"a": ask("true")}, {"a": 3}, ["at"])
    assert {r.id for r in nobody.collect()} == {0, 1, 2}


def test_rejected_audit_as_files(spark, tmp_path):
    rows = [(3, 1, "Baker", "Mill", "Turin", "https://a", "no remote"), (1, 1, "Cook", "Inn", None, None, None)]
    df = spark.createDataFrame(rows, "id long, tier int, title string, company string, location string, url string, reason string")
    text_files.write_files(delivery.rejected_lines(df, spark.createDataFrame([(1,), (2,)], "tier int"), "2024-05-01"), str(tmp_path))
    one, two = ((tmp_path / f"2024-05-01/tier{t}/rejected.md").read_text() for t in (1, 2))
    assert one == "\n".join(["# Rejected by remote verification - 2024-05-01 (tier 1)\n", "- **Cook - Inn** ·  · [link]()", "  \n", "- **Baker - Mill** · Turin · [link](https://a)", "  no remote\n"])
    assert two == "\n".join(["# Rejected by remote verification - 2024-05-01 (tier 2)\n", "None. Every offer was confirmed, advised or left with its work mode unstated.\n"])


def test_sending_goes_on_where_it_stopped(spark):
    schema = "day string, tier int, part long, outcome string, status int"
    first = [("d", 1, k, o, 400 if o == "refused" else None) for k, o in enumerate(["ok", "refused", "ok", "down", "ok"])] + [("d", 2, 0, "ok", None)]
    none = spark.createDataFrame([], "day string, tier int, next long, accepted long, refused_status int")
    once = delivery.sent_progress(none, spark.createDataFrame(first, schema), ["day", "tier"])
    assert sorted(map(tuple, once.collect())) == [("d", 1, 5, 3, 2, 400, "due"), ("d", 2, 1, 1, 1, None, "sent")]
    again = [(*r[:3], "ok", None) for r in first]  # what was refused isn't sent again
    twice = delivery.sent_progress(once.select("day", "tier", "next", "accepted", "refused_status"), spark.createDataFrame(again, schema), ["day", "tier"])
    assert sorted(map(tuple, twice.collect())) == [("d", 1, 5, 5, 4, 400, "refused"), ("d", 2, 1, 1, 1, None, "sent")]


CV = "# Name  \r\n\n## Summary\nText.\n- no role\n\n## Experience\n\n**First Role**\n  - one thing  \n\t- two things\n  : more\n- third\n\n**Second Role**\n- only\n\n## Skills\n**Tools:** x\n- lp.a :: b\n"


def test_assembled_cvs_keep_all_else(spark):
    docs = spark.createDataFrame([("a", CV), ("b", CV), ("c", None), ("d", "no roles")], "id string, text string")
    plan = spark.createDataFrame([("a", 1, 2, "2 things"), ("a", 2, 1, "own $1 \\1"), ("b", 1, 1, "one thing")], "id string, role_no long, place long, content string")
    got = {r.id: r.text for r in cv.assembled(docs, "id", "text", plan).collect()}
    assert got["a"] == CV.replace("two things", "2 things").replace("- only", "- own $1 \\1")
    assert got["b"] == CV and got["c"] == "" and got["d"] == "no roles"
    # taken apart again, the plan is there
    parsed = cv.cv_lines(spark.createDataFrame([("a", got["a"])], "id string, text string"), "id", "text").filter("kind = 'bullet' AND role IS NOT NULL").orderBy("line")
    assert [(r.role, r.content) for r in parsed.collect()] == [("First Role", "one thing"), ("First Role", "2 things"), ("First Role", "third"), ("Second Role", "own $1 \\1")]


def test_problems_of_a_plan(spark):
    docs = spark.createDataFrame([("a", CV)], "id string, text string")
    plan = [("a", 1, 1, "one thing"), ("a", 1, 2, "two things more"), ("a", 1, 3, "x\ny"), ("a", 1, 4, "x"), ("a", 3, 1, "x"), ("a", 2, 1, "x"), ("a", 2, 1, "y"), ("z", 1, 1, "x")]
    got = cv.plan_problems(docs, "id", "text", spark.createDataFrame(plan, "id string, role_no long, place long, content string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 2, "too long"), ("a", 1, 3, "line break"), ("a", 1, 4, "no such bullet"), ("a", 2, 1, "several rows"), ("a", 3, 1, "no such bullet"), ("z", 1, 1, "no such bullet")]


def test_languages_from_profiles(spark, monkeypatch):
    said = {"en": "the house and the river were under the green tree near the mill", "it": "la casa e il fiume erano sotto l'albero verde vicino al mulino", "de": "das haus und der fluss waren unter dem grünen baum an der mühle"}
    random.seed(1)
    some = lambda lang, n: " ".join(random.choices(said[lang].split(), k=n))
    train = spark.createDataFrame([(k, some(lang, 20), lang) for k in range(40) for lang in said] + [(999, "x y z", None)], "doc_id long, text string, lang string")
    table = languages.profiles(train)
    asked = [(k, some(lang, 12), lang) for k, lang in enumerate(list(said) * 10)] + [(100, None, None), (101, "short", None), (102, "1234 5678 " * 10, None), (103, "zzzz qqqq wwww " * 10, None)]
    got = {r.id: r.language for r in languages.detected(spark.createDataFrame(asked, "id long, text string, lang string"), "id", table).collect()}
    assert len(got) == len(asked) and all(got[k] == lang for k, _, lang in asked if k < 100)
    assert [got[k] for k in (100, 101, 102)] == [None] * 3 and got[103] in said
    # texts are told without moving them, and as by joins
    asked += [(104, "THE MILL\U00010400near ἀγορά İstanbul " * 5, None), (105, "casa das " * 30, None)]
    df = spark.createDataFrame(asked, "id long, text string, lang string")
    held = spark.createDataFrame(table.collect(), table.schema)
    found = languages.detected(df, "id", held)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, languages._joined(df, "id", held, "text", 40).collect()))
    monkeypatch.setattr(languages, "_PIECE", 7)
    assert sorted(map(tuple, languages.detected(df, "id", held).collect())) == sorted(map(tuple, found.collect()))
    # a gain of the profile is that of plain counting
    (row,) = table.filter("lang = 'en' AND gram = ' th'").collect()
    (least,) = table.filter("lang = 'en' AND gram = '?'").collect()
    assert row.score > least.score and table.filter("gram = '?'").count() == 3


ORDERS, DEFAULT = {1: [TitleClass("city", "ai", False), TitleClass("country", "ai", True), TitleClass("rest", "other")]}, [TitleClass("ai", "ai"), TitleClass("plain", "other", False)]


@pytest.mark.parametrize(("tier", "title", "wide", "rank", "value"), [(1, "AI Baker", False, 0, 0), (1, "AI Baker", True, 1, 4), (1, "Senior AI Baker", True, 2, 99), (2, "AI Baker", True, 0, 1), (2, "Baker", False, 1, 7), (2, "Baker", True, None, 99), (1, "Fair Baker", False, 2, 99)])
def test_title_ranks(spark, tier, title, wide, rank, value):
    df = spark.createDataFrame([(tier, title, wide)], "tier int, title string, wide boolean")
    kind = queueing.title_kind(F.col("title"), ["AI", "ML"], ["Senior"])
    found = queueing.stored_rank(F.col("tier"), kind, F.col("wide"), ORDERS, DEFAULT)
    row = df.select(found.alias("rank"), queueing.value_of_rank(F.col("tier"), found, ORDERS, DEFAULT, {"city": 0, "country": 4, "ai": 1, "plain": 7}).alias("value")).first()
    assert tuple(row) == (rank, value)


def test_lines_of_reports(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 10, None), (dt.date(2024, 1, 2), 13, 2), (dt.date(2024, 1, 3), 9, 2)], "day date, requests int, errors int")
    assert [r.line for r in trend.as_text(days, ["requests", "errors"]).orderBy("day").collect()] == ["2024-01-01  requests 10.00 (?), errors ? (?)", "2024-01-02  requests 13.00 (+3.00), errors 2.00 (?)", "2024-01-03  requests 9.00 (-4.00), errors 2.00 (+0.00)"]
    got = {r.metric: r.line for r in trend.comparison_text(trend.before_after(days, "2024-01-03", ["requests", "errors"], 2)).collect()}
    assert got == {"requests": "requests: 11.50 before, 9.00 after (-21.7 %), indicative only: 2 and 1 days", "errors": "errors: 1.00 before, 2.00 after (+100.0 %), indicative only: 2 and 1 days"}


def test_a_paragraph_ends():
    long = "This paragraph is the only one that has more than fifty characters."
    for page in ("<p>Hi</p><div>" + "navigation " * 20 + "</div><p>" + long + "</p>", "<div><p>Hi<div>" + "menu " * 30 + "</div></div><p>" + long + "<ul><li>" + "x " * 50 + "</ul>", "<article>" + long + "</article>" + "footer " * 30):
        assert pages.describe(page, "Baker", "Mill") == (long, "partial", None)
    assert pages.describe("<p>Hi</p><div>" + "navigation " * 20 + "</div>", "Baker", "Mill") == ("Baker at Mill", "partial", None)
    assert pages.describe("", "Baker", "Mill")[0] == "Baker at Mill"


@pytest.mark.parametrize(("raw", "want"), [("Petr Čech", "petr cech"), ("Plzeň", "plzen"), ("Győr", "gyor"), ("Iași", "iasi"), ("Łódź", "odz"), ("Café Olé", "cafe ole"), ("Ｂａｋｅｒ ²", "baker 2"), ("Đà Nẵng", "a nang"), ("日本 x", "x"), (None, None)])
def test_titles_in_all_latin_letters(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalize_title(F.col("t"))).first()[0] == want
    register_all(spark, "q_")
    assert df.selectExpr("q_title_key(t)").first()[0] == want


def test_functions_in_sql(spark):
    register_all(spark, "q_")
    log = spark.createDataFrame([("a", k, o) for k, o in enumerate(["ok", "ok", "refused", "ok"])] + [("b", 1, None), ("b", 2, None)], "host string, at int, outcome string").repartition(3)
    log.createOrReplaceTempView("q_log")
    got = spark.sql("SELECT * FROM q_runs(TABLE(q_log) PARTITION BY host ORDER BY (at), 'host')").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "ok", 2, 0, 1), ("a", "refused", 1, 2, 2), ("a", "ok", 1, 3, 3), ("b", None, 2, 1, 2)], key=str)
    for wrong in ("q_runs(TABLE(q_log) PARTITION BY host ORDER BY (at), 'nothing')", "q_runs(TABLE(SELECT host FROM q_log) PARTITION BY host ORDER BY (host), 'host')"):
        with pytest.raises(Exception, match="no column"):
            spark.sql(f"SELECT * FROM {wrong}").collect()
    row = spark.sql("SELECT q_wilson_upper(0, 0), q_wilson_upper(3, 10), q_rate(1, 0), q_company_key('Müller GmbH & Co. KG'), q_language_passes('x', 'de'), q_language_passes(repeat('x', 50), 'de'), q_policy_excerpt('remote work')").first()
    assert row[0] == 1.0 and 0.6 < row[1] < 0.61 and row[2] is None and row[3] == "muller" and row[4] is True and row[5] is False and row[6] == "remote work"
