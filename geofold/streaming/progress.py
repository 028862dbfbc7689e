"""Progress of streaming jobs, kept by a listener of the session."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """The last batches of every query: rows in, rows a second, state rows and watermark; and how queries ended."""

    def __init__(self, keep: int = 100):
        self.batches: deque[dict] = deque(maxlen=keep)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({
            "query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "watermark": p.eventTime.get("watermark"),
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def watch(spark: SparkSession, keep: int = 100) -> Progress:
    """Listen to all queries of the session; take it off with ``spark.streams.removeListener``."""
    listener = Progress(keep)
    spark.streams.addListener(listener)
    return listener
