"""Sources with offsets, sinks that commit or leave nothing, state that expires and beats of streams."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.timeutil import at
from millrace.operators import health
from millrace.sources import store, text_files, walk_pages
from millrace.streaming import beats, expiring

BEGIN = dt.datetime(2024, 3, 28, 22, 30)


def page(root, slice_, start, cards, end=None):
    folder = root / slice_
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{start}-{start + len(cards) if end is None else end}.jsonl").write_text("\n".join(json.dumps(c) if isinstance(c, dict) else c for c in cards))


def cards_in(spark, out):
    return sorted((r.slice, r.start, r.place, r.id) for r in spark.read.parquet(str(out)).withColumn("id", F.get_json_object("card", "$.id").cast("int")).collect())


def test_a_stopped_walk_goes_on_at_its_page(spark, tmp_path):
    root, out, want = tmp_path / "walks", tmp_path / "out", []
    for s in ("a", "b"):
        for p in range(6):
            page(root, s, p * 3, [{"id": 100 * p + k} for k in range(3)])
            want += [(s, p * 3, k, 100 * p + k) for k in range(3)]

    def start(most):
        stream = walk_pages.walk_cards(spark, str(root), most, str(tmp_path / "ck"))
        return stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()

    def batches():
        logged = sorted((int(p.name) for p in (tmp_path / "ck" / "offsets").iterdir() if p.name.isdigit()))
        return [json.loads((tmp_path / "ck" / "offsets" / str(n)).read_text().splitlines()[-1]) for n in logged]

    q = start(2)
    q.processAllAvailable()
    q.stop()
    assert [x["a"] for x in batches()] == [6, 12, 18]
    assert cards_in(spark, out) == sorted(want)
    # a batch whose commit was lost runs again; its files don't count twice
    (last,) = [p for p in (tmp_path / "ck" / "commits").iterdir() if p.name == "2"]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    # later pages: one with lines that are no cards, one that was fetched twice, one behind a gap, and a new slice
    page(root, "a", 18, [{"id": 7}, "no json", "[1]"])
    page(root, "a", 21, [{"id": 8}])
    page(root, "a", 21, [{"id": 8}, {"id": 9}])
    page(root, "b", 30, [{"id": 1}])
    page(root, "c", 0, [{"id": 5}])
    page(root, "c", 1, [], end=1)
    want += [("a", 18, 0, 7), ("a", 21, 0, 8), ("a", 21, 1, 9), ("c", 0, 0, 5)]
    q = start(2)
    q.processAllAvailable()
    assert cards_in(spark, out) == sorted(want)
    page(root, "b", 18, [{"id": k} for k in range(12)])
    q.processAllAvailable()
    q.stop()
    assert cards_in(spark, out) == sorted(want + [("b", 18, k, k) for k in range(12)] + [("b", 30, 0, 1)])


def test_pages_of_a_slice():
    pages = walk_pages.pages_of(["0-3.jsonl", "0-2.jsonl", "3-3.jsonl", "3-5.jsonl", "x.jsonl", "9-12.jsonl", "5-4.jsonl"])
    assert pages == {0: (3, "0-3.jsonl"), 3: (5, "3-5.jsonl"), 9: (12, "9-12.jsonl")}
    assert list(walk_pages.reached(pages, 0)) == [(0, "0-3.jsonl"), (3, "3-5.jsonl")]
    assert list(walk_pages.reached(pages, 0, 1)) == [(0, "0-3.jsonl")] and not list(walk_pages.reached(pages, 5))


def test_many_walks_are_read_by_few_tasks_from_one_listing(tmp_path, monkeypatch):
    for k in range(600):
        page(tmp_path, f"s{k}", 0, [{"id": k}])
        page(tmp_path, f"s{k}", 1, [{"id": k}])
    reader, listings = walk_pages._Reader({"path": str(tmp_path), "pagesPerBatch": "1", "checkpoint": str(tmp_path / "none")}), []
    listed = reader._listed
    monkeypatch.setattr(reader, "_listed", lambda: listings.append(1) or listed())
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert end == {f"s{k}": 1 for k in range(600)} and len(parts) <= walk_pages.MOST_PARTS and len(listings) == 1
    rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == sorted((f"s{k}", 0, 0, json.dumps({"id": k})) for k in range(600))


def files_below(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")} if root.exists() else {}


def test_text_files_are_stable_and_whole(spark, tmp_path):
    rows = [(f"2024-01-0{k % 3 + 1}/tier{k % 2}/{k % 7}.md", k, f"Zeile {k} ü\n") for k in range(500)] + [("none.md", 0, None)]
    want = {}
    for path, _, text in rows:
        want[path] = want.get(path, "") + (text or "")
    for parts in (1, 5):
        text_files.write_files(spark.createDataFrame(rows, "path string, n long, text string").repartition(parts), f"file://{tmp_path}/out")
        assert files_below(tmp_path / "out") == want
        assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".stage")]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "1.md").write_text("old")
    rows = spark.createDataFrame([(f"{k}.md", 0, "new") for k in range(50)], "path string, n long, text string")
    broken = rows.withColumn("text", F.when(F.col("path") == "31.md", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    for df in (broken, rows.union(spark.createDataFrame([("../out.md", 0, "x")], rows.schema)), rows.union(spark.createDataFrame([("/tmp/out.md", 0, "x")], rows.schema)), rows.union(spark.createDataFrame([("./1.md", 0, "x")], rows.schema))):
        with pytest.raises(Exception):  # noqa: B017
            text_files.write_files(df, str(tmp_path / "out"))
        assert files_below(tmp_path) == {"out/1.md": "old"}
        assert [p.name for p in (tmp_path / "out").iterdir()] == ["1.md"]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", expiring.STATE_STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream_of(spark, rows, schema, folder, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(stream, tmp_path):
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


@pytest.mark.parametrize("parts", [1, 4])
def test_deferred_links_leave_by_themselves(rocks, tmp_path, parts):
    spark, zone = rocks, "Europe/Rome"
    random.seed(5)
    rows = sorted(((f"l{random.randint(0, 25)}", random.choice(["scoring", "throttled"]), random.choice(["failed", "failed", "done"]), BEGIN + dt.timedelta(minutes=random.randint(0, 12_000))) for _ in range(300)), key=lambda r: r[3])
    rows.append(("last", "scoring", "failed", BEGIN + dt.timedelta(days=40)))  # moves the watermark past all others
    got = drained(expiring.deferred(stream_of(spark, rows, "link string, kind string, outcome string, at timestamp", tmp_path / "in", parts), zone=zone), tmp_path)
    # the batch form, at every row: the queue that is live then
    want, queue = [], {}
    utc = dt.UTC
    for link, kind, outcome, now in rows:
        moment = lambda t: int(t.replace(tzinfo=utc).timestamp() * 1000)
        if (link, kind) in queue:
            ends = expiring.end_of(kind, moment(queue[link, kind]), 3, 2, zone)
            if moment(now) >= ends:
                want.append((link, kind, "expired", queue.pop((link, kind)), dt.datetime.fromtimestamp(ends / 1000, utc).replace(tzinfo=None)))
        if outcome == "done":
            if (link, kind) in queue:
                want.append((link, kind, "done", queue.pop((link, kind)), now))
        elif (link, kind) not in queue:
            queue[link, kind] = now
            want.append((link, kind, "queued", now, now))
    for (link, kind), queued in queue.items():
        if link != "last":
            want.append((link, kind, "expired", queued, dt.datetime.fromtimestamp(expiring.end_of(kind, int(queued.replace(tzinfo=utc).timestamp() * 1000), 3, 2, zone) / 1000, utc).replace(tzinfo=None)))
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.event for r in got} == {"queued", "done", "expired"}
    # what has been queued and is neither done nor expired is the queue that the batch filter keeps
    for day in (2, 4, 6):
        now = BEGIN + dt.timedelta(days=day)
        state = {}
        for r in sorted((r for r in got if r.at <= now), key=lambda r: (r.at, r.event == "queued")):
            state.pop((r.link, r.kind), None)
            if r.event == "queued":
                state[r.link, r.kind] = r.queued_at
        queued = spark.createDataFrame([(*k, t) for k, t in state.items()], "link string, kind string, queued_at timestamp")
        live = store.live_deferred(queued, at(str(now)).cast("timestamp"), zone=zone)
        assert {(r.link, r.kind) for r in live.collect()} == set(state)


def test_end_of_calendar_days_over_a_change_of_the_clock():
    queued = int(dt.datetime(2024, 3, 30, 23, 30, tzinfo=dt.UTC).timestamp() * 1000)  # the 31st in Rome, when clocks go forward
    assert expiring.end_of("throttled", queued, 3, 2, "Europe/Rome") == int(dt.datetime(2024, 4, 1, 22, tzinfo=dt.UTC).timestamp() * 1000)
    assert expiring.end_of("scoring", queued, 3, 2, "Europe/Rome") == queued + 3 * 86_400_000


@pytest.mark.parametrize("parts", [1, 3])
def test_alerts_are_taken_back(rocks, tmp_path, parts):
    random.seed(8)
    rows = sorted(((f"k{random.randint(0, 4)}", BEGIN + dt.timedelta(minutes=random.randint(0, 20_000)), n) for n in range(150)), key=lambda r: r[1])
    rows.append(("last", BEGIN + dt.timedelta(days=60), 999))
    got = drained(expiring.alerts_and_recoveries(stream_of(rocks, rows, "key string, at timestamp, event_id long", tmp_path / "in", parts), 6 * 3600, 24 * 3600), tmp_path)
    want, by = [], {}
    for key, when, event_id in rows:
        sent, seen = by.get(key, (None, None))
        if seen is not None and when - seen >= dt.timedelta(hours=24):
            want.append((key, None, "recovered", seen + dt.timedelta(hours=24)))
            sent = None
        if sent is None or when - sent >= dt.timedelta(hours=6):
            want.append((key, event_id, "sent", when))
            sent = when
        by[key] = sent, when
    want += [(key, None, "recovered", seen + dt.timedelta(hours=24)) for key, (_, seen) in by.items() if key != "last"]
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(got) == order(want)


class Calls:
    """A state store of one value and its timers, which lists what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


@pytest.mark.parametrize("keys", [1, 500])
def test_a_batch_asks_the_store_a_few_times_whatever_its_keys(keys):
    day = pd.Timestamp("2024-01-01")
    rows = [(f"k{k}", "scoring", "failed", day + pd.Timedelta(minutes=k), k) for k in range(keys)]
    batch = pd.DataFrame(rows, columns=["link", "kind", "outcome", "at", "event_id"])
    for processor, columns in ((expiring._Queue(3, 2, "UTC"), {}), (expiring._Alerts(3600.0, 86_400.0), {"link": "key"})):
        store_ = Calls()
        processor.init(store_)
        for shift, timers in ((0, 1), (1, 1)):
            own = batch.rename(columns=columns).assign(at=batch["at"] + pd.Timedelta(hours=shift))
            list(processor.handleInputRows((0,), iter([own]), None))
            assert len(store_.calls) <= 4 and len(store_.timers) == timers
            store_.calls.clear()


def test_streams_leave_beats(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(10)], "n long").write.parquet(str(tmp_path / "in"))
    listener = beats.Beats(f"file://{tmp_path}/beats")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("noop").queryName("reader").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        rows = beats.beats(spark, str(tmp_path / "beats"))
        now = F.lit(dt.datetime.now() + dt.timedelta(hours=1)).cast("timestamp")
        (live,) = health.liveness(beats.running(rows).select("service", "at"), "service", now, 60).collect()
        assert live.service == "reader" and live.is_silent and 3000e6 < live.age_us < 4000e6
        assert rows.agg(F.sum("rows")).first()[0] == 10
        q.stop()
        spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    rows = beats.beats(spark, str(tmp_path / "beats"))
    assert {"started", "progress", "ended"} <= {r.event for r in rows.collect()}
    assert beats.running(rows).count() == 0
