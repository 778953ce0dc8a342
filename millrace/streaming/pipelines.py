"""Streams of request events: first occurrences, day counters, the rate ladder, alerts, batches and keyed sinks.

Each takes a streaming DataFrame and returns one, or starts a query; the folds are the ones of the batch
operators. Event time is a TIMESTAMP: watermarks don't accept wall-clock times without a zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import ladder
from millrace.operators.health import should_send
from millrace.sources.store import file_system


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, ``at`` as a TIMESTAMP."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("at", F.col("at").cast("timestamp"))


def first_only(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once, however often its record is replayed within ``late``; state older than that goes."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def day_counts(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Requests and refusals per key and UTC day; a day is final once the watermark has passed it."""
    w = F.window("at", "1 day")
    found = stream.withWatermark("at", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "refused").alias("refused"))
    return found.select(F.to_date("w.start").alias("day"), *keys, "requests", "refused")


def sessions(stream: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of requests with no gap of ``gap``."""
    w = F.session_window("at", gap)
    found = stream.withWatermark("at", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("requests"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def ladder_levels(stream: DataFrame, policy: ladder.Policy, signals: ladder.Signals, level: int = 1, zone: str = "UTC") -> DataFrame:
    """host, event_id, level and move for each event (host, at, event_id, result); a host's state is its JSON, days are those of ``zone``."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = ladder.State.of(state.get[0]) if state.exists else ladder.State(level=level, active=True)
        batch = pd.concat(list(parts)).sort_values(["t", "event_id"])
        out = []
        for t, day, event_id, result in zip(batch["t"], batch["day"], batch["event_id"], batch["result"], strict=True):
            move = ladder.step(now, t, int(day), result, policy, signals, throughput=False)
            out.append((key[0], event_id, now.level, move))
        state.update((now.json(),))
        yield pd.DataFrame(out, columns=["host", "event_id", "level", "move"])

    timed = stream.select("host", (F.unix_micros("at") / 1e6).alias("t"), F.unix_date(F.from_utc_timestamp("at", zone).cast("date")).alias("day"), "event_id", "result")
    return timed.groupBy("host").applyInPandasWithState(fold, ladder.REPLAY, "state string", "append", GroupStateTimeout.NoTimeout)


def alerts(stream: DataFrame, repeat_s: float, forget: str = "7 days") -> DataFrame:
    """Which occurrences of an issue (key, at, event_id) are sent; an issue not seen for ``forget`` is forgotten."""
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent = state.get[0] if state.exists else None
        batch = pd.concat(list(parts)).sort_values(["at", "event_id"])
        out, latest = [], 0.0
        for at, event_id in zip(batch["at"], batch["event_id"], strict=True):
            t = latest = at.timestamp()
            send = should_send(sent, t, repeat_s)
            sent = t if send else sent
            out.append((key[0], event_id, send))
        state.update((sent,))
        state.setTimeoutTimestamp(max(int(latest * 1000) + forget_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "sent"])

    return stream.withWatermark("at", "1 day").groupBy("key").applyInPandasWithState(fold, "key string, event_id long, sent boolean", "sent double", "append", GroupStateTimeout.EventTimeTimeout)


def batches(stream: DataFrame, size: int, patience_ms: int) -> DataFrame:
    """Full batches of a key's rows (key, id), and what waits once the oldest has waited ``patience_ms`` of processing time: key, batch, ids."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, number = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        timed_out = state.hasTimedOut
        if not timed_out:
            for part in parts:
                waiting += sorted(part["id"].tolist())
        out = []
        while len(waiting) >= size or (timed_out and waiting):
            out.append((key[0], number, waiting[:size]))
            waiting, number = waiting[size:], number + 1
        state.update((waiting, number))
        if waiting:
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(out, columns=["key", "batch", "ids"])

    return stream.groupBy("key").applyInPandasWithState(fold, "key string, batch long, ids array<long>", "waiting array<long>, number long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append what is there to a Parquet folder and stop; the checkpoint resumes where the last run ended."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert_available(stream: DataFrame, root: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """Fold micro-batches into versions of a keyed table: version n+1 is ``merge(version n or None, batch n)``.

    A batch that is run again writes its own version again from the one before, so effects happen once. Each batch writes the
    whole table; versions before the last two go when a new one is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{root}/v{number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{root}/v{number}")
        files, old = file_system(spark, f"{root}/v{number - 2}")
        if number > 1 and files.exists(old):
            files.delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
