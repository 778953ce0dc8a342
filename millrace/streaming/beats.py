"""Heartbeats of this engine's own streams: a listener that writes every sign of life, and the table of them for ``liveness``."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from millrace.sources.shared_files import opened

SCHEMA = "service string, event string, at timestamp, batch long, rows long, failure string"


class Beats(StreamingQueryListener):
    """Writes a line for each start, batch, idle moment and end of a query, below ``path`` by day; a folder that can't be written never stops a query."""

    def __init__(self, path: str) -> None:
        self.path, self.names = path, {}

    def _write(self, run: object, event: str, batch: int | None = None, rows: int | None = None, failure: str | None = None) -> None:
        now = datetime.now(UTC)
        line = {"service": self.names.get(str(run), str(run)), "event": event, "at": now.isoformat(timespec="microseconds"), "batch": batch, "rows": rows, "failure": failure}
        try:
            files, root = opened(self.path)
            files.create_dir(f"{root}/day={now.date()}")
            with files.open_output_stream(f"{root}/day={now.date()}/{now.timestamp():.6f}-{uuid.uuid4().hex[:8]}.json") as out:
                out.write(json.dumps(line).encode() + b"\n")
        except OSError:
            pass

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self._write(event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.names.setdefault(str(p.runId), p.name or str(p.id))
        self._write(p.runId, "progress", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._write(event.runId, "idle")

    def onQueryTerminated(self, event) -> None:
        self._write(event.runId, "failed" if event.exception else "ended", failure=event.exception and event.exception[:500])


def beats(spark: SparkSession, path: str) -> DataFrame:
    """All beats below ``path``."""
    return spark.read.schema(SCHEMA).json(f"{path}/day=*")


def running(beat_rows: DataFrame) -> DataFrame:
    """The beats of the services whose last one is no end: what :func:`~millrace.operators.health.liveness` is asked about."""
    last = beat_rows.groupBy("service").agg(F.max_by("event", "at").alias("_last")).filter(~F.col("_last").isin("ended", "failed"))
    return beat_rows.join(last.select("service"), "service", "left_semi")
