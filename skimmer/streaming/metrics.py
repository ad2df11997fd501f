"""Counts of a run, observed where rows pass: no pass of their own. On batches by Observation, on streams by a listener."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


def watched(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
    """rows, with aggregates of what passes here under this name."""
    return rows.observe(name, *(c.alias(k) for k, c in counts.items()))


def watched_batch(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """(rows, observation); observation.get has the counts once an action has run."""
    seen = Observation(name)
    return rows.observe(seen, *(c.alias(k) for k, c in counts.items())), seen


class Counts(StreamingQueryListener):
    """Sums what streams observe: ``total("received", "n")``. A batch that runs again after a failure counts once."""

    def __init__(self, log=None):
        self.batches: dict = {}
        self.log, self.ended = log, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            self.batches[str(p.id), p.batchId, name] = row.asDict()
        if self.log:
            self.log(p.name, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def total(self, name: str, count: str) -> int:
        return sum(row[count] or 0 for (_, _, n), row in self.batches.items() if n == name)

    def wait(self, seconds: float = 60) -> "Counts":
        """Until the stream's end is known here: events come in order, so all of its batches are, too."""
        self.ended.wait(seconds)
        return self
