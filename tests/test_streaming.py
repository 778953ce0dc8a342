"""Streams give what the batch operators give over the same events."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import health, ladder
from millrace.sources import store
from millrace.streaming import pipelines

SCHEMA = "event_id long, host string, at timestamp, outcome string, result string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(9)
    rows = []
    for k in range(1500):
        o = random.choices(["ok", "refused", "error"], [12, 2, 1])[0]
        rows.append((k, f"h{k % 4}", 1_700_000_000 + k * 90, o, {"ok": "clean", "refused": "refused"}.get(o, "neutral")))
    df = spark.createDataFrame(rows, "event_id long, host string, t long, outcome string, result string").withColumn("at", F.timestamp_seconds("t")).select("event_id", "host", "at", "outcome", "result")
    path = str(tmp_path_factory.mktemp("events") / "in")
    for part in range(3):  # in order of time, as logs arrive
        df.filter(F.floor(F.col("event_id") / 500) == part).coalesce(1).write.mode("append").parquet(path)
    return path


def run(stream, tmp_path, mode="append"):
    spark = stream.sparkSession
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_first_only(spark, folder, tmp_path):
    stream = pipelines.events(spark, folder, SCHEMA)
    twice = stream.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    assert run(pipelines.first_only(twice, "event_id"), tmp_path).count() == 1500


def test_day_counts(spark, folder, tmp_path):
    got = run(pipelines.day_counts(pipelines.events(spark, folder, SCHEMA, 1), ["host"]), tmp_path, "complete")
    want = spark.read.parquet(folder).groupBy(F.to_date("at").alias("day"), "host").agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "refused").alias("refused"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ladder(spark, folder, tmp_path):
    # the three files are read in one trigger each or all at once: a host's events come in order of time
    got = run(pipelines.ladder_levels(pipelines.events(spark, folder, SCHEMA), ladder.Policy(), ladder.Signals()), tmp_path)
    batch = spark.read.parquet(folder).select("host", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("t"), F.unix_date(F.to_date("at")).alias("day"), "event_id", F.col("result").alias("outcome"), F.lit(None).cast("string").alias("block"))
    want = ladder.replay(batch, ladder.Policy(), ladder.Signals())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_alerts(spark, folder, tmp_path):
    bad = lambda df: df.filter("outcome = 'refused'").select(F.col("host").alias("key"), "at", "event_id")
    got = run(pipelines.alerts(bad(pipelines.events(spark, folder, SCHEMA)), 3600), tmp_path)
    want = health.ledger(bad(spark.read.parquet(folder)), 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batches(spark, folder, tmp_path):
    stream = pipelines.events(spark, folder, SCHEMA).select(F.col("host").alias("key"), F.col("event_id").alias("id"))
    # a processing-time timeout keeps a query going for ever, so this one is stopped when it has said all
    q = pipelines.batches(stream, 8, 3_600_000).writeStream.format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    want, until = 4 * (375 // 8), time.time() + 90
    while spark.table("batches").count() < want and time.time() < until:
        time.sleep(1)
    got = spark.table("batches").collect()
    q.stop()
    assert all(len(r.ids) == 8 for r in got) and len({i for r in got for i in r.ids}) == 8 * len(got) == 4 * (375 // 8) * 8


def test_resume_and_upsert(spark, folder, tmp_path):
    stream = pipelines.events(spark, folder, SCHEMA, 1)
    empty = spark.createDataFrame([], "host string, first_seen timestamp, last_seen timestamp, seen_count long")
    merge = lambda before, batch: store.refresh_upsert(before if before is not None else empty, batch, ["host"])
    for _ in range(2):  # the second run finds nothing new
        assert pipelines.upsert_available(stream, str(tmp_path / "t"), str(tmp_path / "ck"), merge).awaitTermination(120) is not False
    last = max((tmp_path / "t").iterdir(), key=lambda p: int(p.name[1:]))
    assert {r.host: r.seen_count for r in spark.read.parquet(str(last)).collect()} == {f"h{k}": 375 for k in range(4)}


def test_append_sink(spark, folder, tmp_path):
    for _ in range(2):
        pipelines.run_available(pipelines.events(spark, folder, SCHEMA), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1500
