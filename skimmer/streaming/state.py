"""Keyed state of the engine, touched entry by entry and kept in RocksDB; it ends by event time.

Values of a state are read and written alone: a row costs its own look-ups, whatever else its key remembers. Rows of a micro-batch
are put in order of arrival first, which holds one batch's rows of one key. Rows that come later than the watermark are left out.
Rows come as they are, not as pandas frames: those cost milliseconds a key, and hold no time after 2262.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skimmer.operators.push import LOWER, WIDER, WINDOW

DAY_MS = 86_400_000


def rocks(spark: SparkSession) -> None:
    """State of streams that start from now on is kept in RocksDB, as the processors here need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(ts: datetime) -> int:
    """Milliseconds since 1970, whole ones."""
    return (ts.replace(tzinfo=ts.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def _day_ms(day: str) -> int:
    """The beginning of a day (yyyyMMdd, with hyphens or not)."""
    day = day.replace("-", "")
    return _ms(datetime(int(day[:-4]), int(day[-4:-2]), int(day[-2:])))


def _gathered(rows, order: str, ts: str, late: int) -> list:
    """A key's rows of this batch in order, but those from before ``late``: Spark itself tests against the batch before."""
    got = [r for r in rows if r[ts] is not None and _ms(r[ts]) >= max(late, 0)]
    return sorted(got, key=lambda r: (r[order] is None, r[order] or 0))


class FirstContent(StatefulProcessor):
    """The first row of each key, by seq; a key is forgotten keep_ms after the latest row that asked for it."""

    def __init__(self, keep_ms: int, ts: str = "ts", order: str = "seq"):
        self.keep_ms, self.ts, self.order = keep_ms, ts, order

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        now = timerValues.getCurrentWatermarkInMs()
        got = _gathered(rows, self.order, self.ts, now)
        if not got:
            return
        known = self.until.get()
        if known is not None and known[0] <= now:  # its timer goes off after this batch
            self.handle.deleteTimer(known[0])
            known = None
        until = max(_ms(r[self.ts]) for r in got) + self.keep_ms
        if known is None or until > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.until.update((until,))
            self.handle.registerTimer(until)
        if known is None:
            yield got[0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


class Decide(StatefulProcessor):
    """The push decision of a scope of rows (seq, score, threshold, day[, orig_id][, hash][, predicted]).

    State: the counter of the scope, and an entry each for the origins that it pushed and the contents that it let pass. related:
    rows that aren't pushed come out too, unless their origin was pushed before; contents: or their content was let pass before.
    adaptive: once received / predicted is over the window, the threshold falls and the window rises; both are then part of the
    counter's state. The scope ends keep_days after the watermark has passed its day."""

    def __init__(self, cap: int, keep_days: int, related: bool, contents: bool, adaptive: bool, columns: list[str]):
        self.cap, self.keep_days, self.related, self.contents, self.adaptive, self.columns = cap, keep_days, related, contents, adaptive, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "received long, pushed long, threshold double, lowered long")
        self.origins = handle.getMapState("origins", "orig string", "seq long")
        self.passed = handle.getMapState("contents", "hash string", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        got = _gathered(rows, "seq", "ts", timerValues.getCurrentWatermarkInMs())
        if not got:
            return
        state, out = self.counter.get(), []
        received, pushed, first, lowered = state if state is not None else (0, 0, None, 0)
        if state is None:
            self.handle.registerTimer(_day_ms(max(r["day"] for r in got)) + (1 + self.keep_days) * DAY_MS)
        # what this batch has met; a scope that is new has nothing else to look up
        known: tuple[dict, dict] = ({}, {})

        def there(which: int, name) -> bool:
            if name not in known[which]:
                known[which][name] = state is not None and (self.origins, self.passed)[which].containsKey((str(name),))
            return known[which][name]

        def keep(which: int, name, seq) -> None:
            known[which][name] = True
            (self.origins, self.passed)[which].updateValue((str(name),), (int(seq),))

        for row in got:
            seq, score, threshold = row["seq"], row["score"], row["threshold"]
            orig, content = row["orig_id"] if self.related else None, row["hash"] if self.contents else None
            predicted = row["predicted"] if self.adaptive else None
            if self.contents and there(1, content) or self.related and there(0, orig):
                continue
            received += 1
            first = threshold if first is None or not self.adaptive else first
            if pushed < self.cap:
                if None not in (score, first) and round(score, 12) > first * LOWER**lowered:
                    pushed += 1
                    if self.related:
                        keep(0, orig, seq)
                    out.append((row, received, pushed, "pushed"))
                lowered += bool(self.adaptive and predicted and received / predicted > WINDOW * WIDER**lowered)
            if self.contents:
                keep(1, content, seq)
            if self.related:
                out.append((row, received, pushed, "related"))
        self.counter.update((received, pushed, None if first is None else float(first), lowered))
        for row, *found in out:
            made = dict(zip(("received", "pushed", "kind"), found))
            yield Row(**{c: made[c] if c in made else row[c] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.counter.clear()
        self.origins.clear()
        self.passed.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_contents(rows: DataFrame, keys: list[str], keep_days: float = 2, ts: str = "ts", order: str = "seq") -> DataFrame:
    """The first row of each key; rows have a watermark on ts. Keys are many and small, so no profile gathers in one task."""
    rocks(rows.sparkSession)
    return rows.groupBy(*keys).transformWithState(FirstContent(int(keep_days * DAY_MS), ts, order), rows.schema, "append", "eventTime", eventTimeColumnName=ts)


def decided(rows: DataFrame, scope: list[str], cap: int, keep_days: int = 2, related: bool = True, contents: bool = False, adaptive: bool = False, more: list[str] = ()) -> DataFrame:
    """Columns of the scope, seq, day, score, received, pushed (counters after the row), kind, and more of rows' columns."""
    rocks(rows.sparkSession)
    made = {"seq": LongType(), "received": LongType(), "pushed": LongType(), "kind": StringType()}
    names = list(dict.fromkeys([*scope, "seq", "day", "score", "received", "pushed", "kind", *more]))
    schema = StructType([StructField(c, made.get(c) or rows.schema[c].dataType) for c in names])
    return rows.groupBy(*scope).transformWithState(Decide(cap, keep_days, related, contents, adaptive, names), schema, "append", "eventTime")
