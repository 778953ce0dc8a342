"""Windows over cut keys give what plain windows give, whatever the size of runs and blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import calls, ordered, requests

BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    random.seed(11)
    hosts = ["hot"] * 8 + ["b", "c", None]
    rows = [(k, random.choice(hosts), BEGIN + dt.timedelta(seconds=random.randint(0, 400_000)), random.choice(["ok", "ok", "refused", "error", None]), random.choice([None, 0.001, 0.002, 0.5, random.random() / 1000])) for k in range(3000)]
    rows += [(3000 + k, "same", BEGIN, "refused", 1.0) for k in range(50)] + [(4000, "single", BEGIN, "ok", None)]
    return spark.createDataFrame(rows, "event_id long, host string, at timestamp_ntz, outcome string, latency double").repartition(7)


def same(got, want, *columns):
    got, want = (sorted(map(str, df.select(*columns).collect())) for df in (got, want))
    assert got == want and got


def test_running_sums(spark, log):
    own = Window.partitionBy("host").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.running(log, "host", ["at", "event_id"], {"n": F.lit(1), "bad": (F.col("outcome") == "refused").cast("int")})
    want = log.withColumns({"n": F.count("*").over(own), "bad": F.count_if(F.col("outcome") == "refused").over(own)})
    same(got, want, "event_id", "host", "n", "bad")
    assert got.columns == [*log.columns, "n", "bad"]


@pytest.mark.parametrize("block", [1, 20, 64, 100_000])
def test_last_twenty_at_any_block(log, block):
    own = Window.partitionBy("host").orderBy("at", "event_id").rowsBetween(-19, 0)
    want = log.withColumns({"in_window": F.count("*").over(own), "refused_in": F.count_if(F.col("outcome") == "refused").over(own)})
    same(requests.trailing_share(log, "host", ["at", "event_id"], block=block), want, "event_id", "in_window", "refused_in")


@pytest.mark.parametrize("block", [20, 33, 100_000])
def test_last_twenty_since_a_move(log, block):
    moved = F.col("outcome") == "error"
    whole = Window.partitionBy("host").orderBy("at", "event_id")
    stint = F.coalesce(F.count_if(moved).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("host", "stint").orderBy("at", "event_id").rowsBetween(-19, 0)
    want = log.withColumn("stint", stint).withColumns({"in_window": F.count("*").over(own), "refused_in": F.count_if(F.col("outcome") == "refused").over(own)})
    same(requests.trailing_share_since(log, "host", ["at", "event_id"], moved, block=block), want, "event_id", "in_window", "refused_in")


@pytest.mark.parametrize("hours", [0, 1, 24])
def test_rolling_hours_with_ties(log, hours):
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    own = Window.partitionBy("host").orderBy(micros).rangeBetween(-hours * 3_600_000_000, 0)
    same(requests.rolling_count(log, "host", hours), log.withColumn("rolling", F.count("*").over(own)), "event_id", "host", "rolling")


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_capped_rate_and_shifted(log, block):
    own = Window.partitionBy("host").orderBy("at", "event_id")
    before = log.withColumn("before", F.lag("event_id").over(own))
    same(ordered.shifted(log, "host", ["at", "event_id"], {"before": F.col("event_id")}, block), before, "event_id", "before")
    gaps = log.withColumn("t", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("host").orderBy("t")))
    want = gaps.groupBy("host").agg(F.coalesce(F.sum(F.least("gap", F.lit(60_000_000)) * F.col("gap").isNotNull().cast("int")), F.lit(0)).alias("busy_us"), F.count("*").alias("requests"))
    same(requests.capped_rate(log, "host", 60, block), want, "host", "requests", "busy_us")


def test_streaks(log):
    rows = sorted(log.collect(), key=lambda r: (str(r.host), r.at, r.event_id))
    want = {}
    last = None
    for r in rows:
        if r.outcome == "refused":
            runs = want.setdefault(r.host, [])
            if last is None or last.host != r.host or last.outcome != "refused":
                runs.append(0)
            runs[-1] += 1
        last = r
    got = {r.host: (r.longest, r.runs) for r in requests.streaks(log, "host", ["at", "event_id"]).collect()}
    assert got == {h: (max(x), len(x)) for h, x in want.items()}


def test_percentiles_of_narrow_and_tiny_values(log):
    got = calls.percentiles(log, ["host"], "latency", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    want = log.groupBy("host").agg(*(F.percentile("latency", p).alias(n) for n, p in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)))).filter("p0 is not null")
    rounded = lambda df: sorted((str(r.host), *(round(x, 12) for x in r[1:])) for r in df.select("host", "p0", "p50", "p95", "p100").collect())
    assert rounded(got) == rounded(want)


def test_empty_log(log):
    none = log.limit(0)
    assert requests.trailing_share(none, "host", ["at", "event_id"]).count() == requests.rolling_count(none, "host").count() == 0


def test_no_window_holds_more_than_a_run_or_block(log):
    """The plans partition their windows by run or block beside the key."""
    for df in (requests.trailing_share(log, "host", ["at", "event_id"]), requests.rolling_count(log, "host"), requests.streaks(log, "host", ["at", "event_id"]), requests.capped_rate(log, "host")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_run" in line or "_block" in line, line
