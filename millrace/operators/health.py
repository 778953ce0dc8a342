"""Liveness and the alert ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.timeutil import micros


def liveness(beats: DataFrame, key: str, now: Column, silent_after_s: int) -> DataFrame:
    """The last beat of each service, its age and whether that is too old."""
    age = micros(now) - micros(F.col("beat_at"))
    return beats.groupBy(key).agg(F.max("at").alias("beat_at")).withColumn("age_us", age).withColumn("is_silent", F.col("age_us") > silent_after_s * 1_000_000)


def should_send(sent_at: float | None, now: float, repeat_s: float) -> bool:
    """An issue is reported when it is new or its last report is ``repeat_s`` old."""
    return sent_at is None or now - sent_at >= repeat_s


def ledger(issues: DataFrame, repeat_s: float) -> DataFrame:
    """Which occurrences of each issue (key, at, event_id) are sent: a fold, as a report restarts the wait only when it is sent."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a partition come by key and time; the state is one time per key
        key, sent = None, None
        for part in parts:
            out = []
            for k, t in zip(part["key"], part["t"], strict=True):
                if k != key:
                    key, sent = k, None
                out.append(should_send(sent, t, repeat_s))
                sent = t if out[-1] else sent
            part["sent"] = out
            yield part[["key", "event_id", "sent"]]

    timed = issues.select("key", (micros("at") / 1e6).alias("t"), "event_id").repartition("key").sortWithinPartitions("key", "t", "event_id")
    return timed.mapInPandas(fold, "key string, event_id long, sent boolean")


def cleared(issues: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """Alerts that were sent and whose issue is gone: each leaves one note of recovery, and its ledger row. issues: key; open_alerts: key, sent_at."""
    return open_alerts.join(issues.select("key").distinct(), "key", "left_anti").select("key", "sent_at", F.lit("recovered").alias("note"))
