"""Line files, settings, registered functions and sessions."""

import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions import geo, text
from millrace.functions.register import register_all
from millrace.functions.timeutil import at, pulled_in
from millrace.operators import delivery, requests
from millrace.sources import config, logs
from millrace.streaming import pipelines


def test_event_csv(spark, tmp_path):
    lines = ["id,at,service,kind,outcome,status,factor,requests_today,spacing_seconds,wait_seconds", "1,2026-10-20 05:00:00.5+02,a,search,ok,200,1.0,3,75,", "2,2026-10-20 05:01:00+02,a,search,refused,429,1.0,4,75,60", "3,2026-10-20 05:02:00+02,a,search,odd,,1.0,5,75,"]
    (tmp_path / "log.csv").write_text("\n".join(lines))
    got = logs.event_csv(spark, str(tmp_path / "log.csv")).orderBy("id").collect()
    assert [r.result for r in got] == ["clean", "refused", "neutral"] and got[1].wait_seconds == 60.0 and got[2].status is None
    assert got[0]["at"].replace(tzinfo=None) == dt.datetime(2026, 10, 20, 3, 0, 0, 500_000)


def test_json_lines_and_usage(spark, tmp_path):
    good = [{"stage": "verification", "timestamp": "2026-10-20T10:00:00Z", "tokens": 5}, {"stage": "verification", "timestamp": "2026-10-20T23:59:59Z", "tokens": 7}, {"stage": "scoring", "timestamp": "2026-10-20T10:00:00Z", "tokens": 9}, {"stage": "verification", "timestamp": "2026-10-21T00:00:00Z", "tokens": 11}]
    bad = ['{"stage": "verification", "timest', "[1, 2]", '{"timestamp": "2026-10-20T10:00:00Z", "tokens": 1}', '{"stage": "x", "timestamp": "2026-10-20T10:00:00Z", "tokens": "many"}', ""]
    (tmp_path / "u.jsonl").write_text("\n".join([*map(json.dumps, good), *bad]))
    got = logs.json_lines(spark, str(tmp_path / "u.jsonl"), "stage string, timestamp timestamp, tokens long", ["stage", "timestamp", "tokens"])
    assert sorted(r.tokens for r in got.collect()) == [5, 7, 9, 11]
    assert logs.used_today(got, "verification", "2026-10-20", "tokens").first().tokens == 12
    assert logs.used_today(got, "nothing", "2026-10-20", "tokens").first().tokens == 0


def test_seen_hashes(spark, tmp_path):
    one = "0123456789abcdef" * 2
    (tmp_path / "seen.txt").write_text(f"{one}\n {one} \n{one[:-1]}\nnonsense\n{'f' * 32}\n")
    assert {r.link_hash for r in logs.seen_hashes(spark, str(tmp_path / "seen.txt")).collect()} == {one, "f" * 32}


def test_notes_are_read_as_they_were_written(spark, tmp_path):
    df = spark.createDataFrame([Row(title="Night Baker", company="Mill: Co", score=7, none=None, body="First line\n\n# Second")], "title string, company string, score int, none string, body string")
    note = df.select(delivery.note_text(F.col("title"), F.col("company"), {"score": F.col("score"), "none": F.col("none"), "at": F.lit("10:30: sharp")}, F.col("body")).alias("t")).first().t
    (tmp_path / "note_12.md").write_text(note)
    got = logs.notes(spark, str(tmp_path)).first()
    assert got.fields == {"score": "7", "at": "10:30: sharp"} and got.heading == "Night Baker at Mill: Co"
    assert (got.file, got.body) == ("note_12.md", "First line\n\n# Second")


def test_samples_are_the_same_for_the_same_seed(spark):
    df = spark.range(200).withColumn("k", F.concat(F.lit("k"), F.col("id").cast("string")))
    take = lambda d, seed: [r.k for r in logs.sample(d, "k", seed, 20).collect()]
    assert take(df, 1) == take(df.repartition(7), 1) and len(set(take(df, 1))) == 20
    assert take(df, 1) != take(df, 2) and len(take(df.limit(5), 1)) == 5


def test_settings(tmp_path):
    def read(kind, raw):
        (tmp_path / "c.json").write_text(json.dumps(raw))
        return config.load(kind, str(tmp_path / "c.json"))

    limits = read(config.Limits, {"limits": [{"provider": "a", "model": "*", "unit": "requests", "per_day": 1000}, {"provider": "a", "model": "m", "unit": "tokens"}]}).limits
    assert config.limit_for(limits, "a", "m").per_day is None and config.limit_for(limits, "a", "other").per_day == 1000 and config.limit_for(limits, "b", "m") is None
    sources = read(config.Sources, {"sources": [{"name": "first", "options": {"first_pull_days": 30}}, {"name": "second", "enabled": False, "interval_hours": 6}]}).sources
    assert sources[0].options["first_pull_days"] == 30 and not sources[1].enabled
    assert read(config.Schedule, {"zone": "Europe/Rome", "spacings": [75, 50.5]}).spacings == [75.0, 50.5]
    assert read(config.Guard, {"primary": {"scoring": "vendor/m"}}).most_other == 0.2
    for kind, raw, word in ((config.Limits, {"limits": [{"provider": "a"}]}, "missing"), (config.Sources, {"sources": [{"name": 1}]}, "name"), (config.Schedule, {"zon": "x"}, "unknown"), (config.Schedule, {"closed_from": True}, "closed_from"), (config.Guard, [], "object")):
        with pytest.raises(ValueError, match=word):
            read(kind, raw)


def test_slices():
    assert config.slices(["baker", "miller"], ["north", "south"]) == [("baker", "north"), ("baker", "south"), ("miller", "north"), ("miller", "south")]
    assert config.slices(["baker", "miller"], ["north", "south"], {"baker": ["south"]}) == [("baker", "south"), ("miller", "north"), ("miller", "south")]
    with pytest.raises(ValueError, match="east"):
        config.slices(["baker"], ["north"], {"baker": ["east"]})


def test_functions_in_sql(spark):
    register_all(spark, "t_")
    page = '<ul><li><div data-entity-urn="u:9"><a class="base-card__full-link" href="https://x/9"></a><h3 class="base-search-card__title">Baker</h3></div></li></ul>'
    assert [(r.job_id, r.title, r.company) for r in spark.sql(f"SELECT * FROM t_cards('{page}')").collect()] == [("9", "Baker", None)]
    got = spark.sql("SELECT t_work_mode('A hybrid role near the mill.', 'Baker', '', false) AS v, t_countries('In Spain and France') AS c").first()
    assert got.v.verdict == "rejected" and got.c == ["France", "Spain"]


def test_places_and_excerpts(spark):
    df = spark.createDataFrame([("Spain",), ("Madrid, Spain",), ("Nowhere",), (None,)], "place string")
    assert [r.v for r in df.select(geo.is_country_only(F.col("place")).alias("v")).collect()] == [True, False, False, False]
    long = spark.createDataFrame([("intro " * 50 + "x" * 900 + " remote work " + "y" * 900,), (None,)], "t string")
    found = [r.v for r in long.select(text.policy_excerpt("remote", 500)("t").alias("v")).collect()]
    assert "remote" in found[0] and len(found[0]) <= 500 and found[1] is None


def test_a_slice_s_time_is_pulled_in(spark):
    day = dt.datetime(2026, 10, 1)
    rows = [(day + dt.timedelta(hours=60), day, "cap_hit"), (day + dt.timedelta(hours=10), day, "cap_hit"), (day + dt.timedelta(hours=60), day, "error"), (day + dt.timedelta(hours=60), None, None)]
    df = spark.createDataFrame(rows, "due timestamp_ntz, walked timestamp_ntz, stop string")
    got = [r.v for r in df.select(pulled_in(F.col("due"), F.col("walked"), F.lit(24), F.col("stop")).alias("v")).collect()]
    assert got == [day + dt.timedelta(hours=h) for h in (24, 10, 60, 60)]
    assert df.select((F.col("due") > at("2026-10-01 00:00:00")).alias("v")).first().v


def test_refusals_by_source(spark):
    rows = [("a", 403, "x"), ("a", 999, "x"), ("b", 999, "x"), ("b", 403, "x"), ("b", None, "refused"), ("a", 200, "ok")]
    df = spark.createDataFrame(rows, "source string, status int, outcome string")
    hit = requests.refused(F.col("outcome"), F.col("status"), {"b": (999,)}, F.col("source"))
    assert [r.v for r in df.select(hit.alias("v")).collect()] == [True, False, True, False, True, False]


def test_sessions(spark, tmp_path):
    start = dt.datetime(2026, 10, 1)
    minutes = {"a": [0, 10, 20, 200, 210], "b": [5]}
    rows = [(h, start + dt.timedelta(minutes=m), i) for h, ms in minutes.items() for i, m in enumerate(ms)]
    spark.createDataFrame(rows, "host string, at timestamp, event_id long").write.parquet(str(tmp_path / "in"))
    stream = pipelines.sessions(pipelines.events(spark, str(tmp_path / "in"), "host string, at timestamp, event_id long"), ["host"])
    q = stream.writeStream.format("memory").queryName("sessions_of_hosts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.host, r.requests) for r in spark.table("sessions_of_hosts").collect()}
    assert got == {("a", 3), ("a", 2), ("b", 1)}


def test_append_log_by_day(spark, tmp_path):
    from millrace.sources import store

    path = str(tmp_path / "log")
    for day in (1, 2, 2):
        store.append_log(spark.createDataFrame([(day, dt.datetime(2026, 10, day, 23))], "id int, at timestamp"), path, "at")
    got = spark.read.parquet(path)
    assert got.count() == 3 and {str(r.day) for r in got.select("day").distinct().collect()} == {"2026-10-01", "2026-10-02"}
