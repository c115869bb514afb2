"""What happens to running streams, as rows: starts, progress with lag and dropped rows, ends.

Spark reports the rows that each micro-batch read, those that came too late and were dropped, and how far event time is
behind. A stream is ready once a micro-batch has ended, and no longer when it ends."""

from __future__ import annotations

import threading
from collections import deque
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENT = "at timestamp, query string, run string, kind string, batch long, rows long, rows_per_second double, late_rows long, watermark timestamp, lag_seconds double, state_rows long, error string"


def _time(text: str | None) -> datetime | None:
    return None if not text else datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)


class RunEvents(StreamingQueryListener):
    """Keeps the newest ``most`` events. Register with ``spark.streams.addListener``."""

    def __init__(self, most: int = 10_000):
        self.events: deque = deque(maxlen=most)
        self.state: dict[str, str] = {}
        self.late: dict[str, int] = {}
        self.lock = threading.Lock()

    def _add(self, run: str, state: str, row: tuple) -> None:
        with self.lock:
            self.state[run] = state
            self.events.append(row)

    def onQueryStarted(self, event) -> None:
        self._add(str(event.runId), "started", (_time(event.timestamp), event.name, str(event.runId), "started", *[None] * 8))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run, at, mark = str(p.runId), _time(p.timestamp), _time(p.eventTime.get("watermark"))
        newest = _time(p.eventTime.get("max"))
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        with self.lock:
            self.late[run] = self.late.get(run, 0) + late
        lag = (newest - mark).total_seconds() if newest and mark else None
        self._add(run, "ready", (at, p.name, run, "progress", p.batchId, p.numInputRows, p.processedRowsPerSecond, late, mark, lag, sum(s.numRowsTotal for s in p.stateOperators), None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        error = event.exception
        self._add(str(event.runId), "failed" if error else "ended", (datetime.now(), None, str(event.runId), "failed" if error else "ended", *[None] * 7, error[:1000] if error else None))

    def ready(self, run: str) -> bool:
        """Whether this run of a stream has ended a micro-batch and goes on."""
        return self.state.get(str(run)) == "ready"

    def dropped(self, run: str) -> int:
        """Rows of this run that came too late."""
        return self.late.get(str(run), 0)

    def rows(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            held = list(self.events)
        return spark.createDataFrame(held, EVENT)
