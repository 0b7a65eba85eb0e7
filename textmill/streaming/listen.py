"""What a stream's progress tells: a watchdog over it, and waiting for a shard that it makes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from textmill.streaming.flows import Stalled


@dataclass
class Seen:
    """What has been heard of one query."""

    batches: int = 0
    rows: int = 0
    late_rows: int = 0
    last_row: float = field(default_factory=time.monotonic)
    ended: bool = False
    error: str | None = None


class Progress(StreamingQueryListener):
    """Collects the progress of all queries of a session; whoever waits is woken by every event."""

    def __init__(self) -> None:
        self.queries: dict[str, Seen] = {}
        self.news = threading.Condition()

    def _heard(self, query: object, change: Callable[[Seen], None]) -> None:
        with self.news:
            change(self.queries.setdefault(str(query), Seen()))
            self.news.notify_all()

    def onQueryStarted(self, event) -> None:
        self._heard(event.id, lambda seen: None)

    def onQueryProgress(self, event) -> None:
        p = event.progress

        def change(seen: Seen) -> None:
            seen.batches, seen.rows = max(seen.batches, p.batchId + 1), seen.rows + p.numInputRows
            seen.late_rows += sum(x.numRowsDroppedByWatermark for x in p.stateOperators)
            if p.numInputRows:
                seen.last_row = time.monotonic()

        self._heard(p.id, change)

    def onQueryIdle(self, event) -> None:
        self._heard(event.id, lambda seen: None)

    def onQueryTerminated(self, event) -> None:
        def change(seen: Seen) -> None:
            seen.ended, seen.error = True, event.exception

        self._heard(event.id, change)

    def of(self, query: StreamingQuery) -> Seen:
        with self.news:
            return self.queries.setdefault(str(query.id), Seen())


def listening(spark: SparkSession) -> Progress:
    """A listener of the session's queries from now on; `spark.streams.removeListener` ends it."""
    progress = Progress()
    spark.streams.addListener(progress)
    return progress


def watch(query: StreamingQuery, progress: Progress, longest_s: float = 300.0) -> Seen:
    """Waits for a query to end; where it handles no row for longest_s, stops it and raises Stalled; where it fails, raises its error."""
    seen = progress.of(query)
    with progress.news:
        while not seen.ended and query.isActive:
            left = seen.last_row + longest_s - time.monotonic()
            if left <= 0:
                break
            progress.news.wait(min(left, 1.0))
    if not seen.ended and query.isActive:
        query.stop()
        raise Stalled(f"no row for {longest_s} s")
    query.awaitTermination()
    return seen


def next_shard[T](ready: Callable[[], T | None], build: Callable[[], T], query: StreamingQuery | None, progress: Progress, *, longest_s: float = 300.0, poll_s: float = 15.0) -> tuple[T, bool]:
    """The next shard, and whether it was built here.

    ready: the shard that the producing query has made, or None.  It is asked whenever the query reports
    progress, and every poll_s.  Where there is no producer, or it has ended, failed or not handled a row
    for longest_s, the shard is built at once, by `build`.
    """
    while True:
        found = ready()
        if found is not None:
            return found, False
        if query is None:
            return build(), True
        seen = progress.of(query)
        if seen.ended or not query.isActive:
            found = ready()  # its last batch may have come meanwhile
            return (found, False) if found is not None else (build(), True)
        if time.monotonic() - seen.last_row > longest_s:
            query.stop()
            return build(), True
        with progress.news:
            progress.news.wait(min(poll_s, max(0.05, seen.last_row + longest_s - time.monotonic())))
