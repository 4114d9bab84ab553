"""Confirmation sessions: a user is asked, and answers within two minutes or not.

A new request re-arms the session; an answer counts only while one is open, and only if it refers to the message
that the open session was asked with.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SESSION = "user_id long, asked_at timestamp, outcome string"


# Spark asks the processor for its state before executors start, in a process without shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ConfirmationProcessor(StatefulProcessor):
    """Input rows: user_id, kind (ask, accept, decline), message (asked with, or answered), ts, seq."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "asked long, message long")

    def _outcome(self, key, asked: int, outcome: str) -> Row:
        import datetime as dt

        return Row(user_id=key[0], asked_at=dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=asked), outcome=outcome)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked, message = self.open.get() if self.open.exists() else (None, None)
        for row in sorted(rows, key=lambda r: (r.ts, r.seq)):
            now = int(row.ts.timestamp()) * 1_000_000 + row.ts.microsecond
            if asked is not None and now >= asked + self.seconds * 1_000_000:
                yield self._outcome(key, asked, "timeout")
                asked = None
            if row.kind == "ask":
                if asked is not None:
                    yield self._outcome(key, asked, "superseded")
                asked, message = now, row.message
            elif asked is not None and row.message == message:
                yield self._outcome(key, asked, "accepted" if row.kind == "accept" else "declined")
                asked = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if asked is None:
            self.open.clear()
        else:
            self.open.update((asked, message))
            self.handle.registerTimer((asked + self.seconds * 1_000_000) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            asked = self.open.get()[0]
            self.open.clear()
            yield self._outcome(key, asked, "timeout")

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, seconds: int = 120, delay: str = "10 minutes") -> DataFrame:
    """How each confirmation ended: accepted, declined, superseded or timeout."""
    return requests.withWatermark("ts", delay).groupBy("user_id").transformWithState(ConfirmationProcessor(seconds), StructType.fromDDL(SESSION), "Append", "EventTime")
