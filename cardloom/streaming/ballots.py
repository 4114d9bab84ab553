"""Ballots as a stream: the batch rules of :mod:`cardloom.operators.ballots`, one state for each ballot.

A ballot opens with its earliest event and closes ``seconds`` later, or with a vote for or against by its owner or
a superuser.  Both are event-time timers: a result goes out when the watermark has passed the time that decides it, so a
vote that comes late, but before the watermark, still counts, in whatever batch.  State is cleared when the result goes
out, and a marker keeps the ballot from opening again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

RESULT = "ballot long, owner long, agree long, disagree long, abstain long, early boolean, result string"


# Spark asks the processor for its state before executors start, in a process without shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decide(agree: int, disagree: int, decision: str | None) -> str:
    """A decision holds; without one an item goes with at least one vote for it and more for than against."""
    remove = decision == "agree" if decision else agree >= 1 and agree > disagree
    return "remove" if remove else "keep"


def _micros(ts) -> int:
    return int(ts.timestamp()) * 1_000_000 + ts.microsecond


class BallotProcessor(StatefulProcessor):
    """Input rows: ballot, owner, voter, choice, ts, seq; they may come in any order before the watermark.

    Votes are kept by voter (their earliest only) until the ballot closes.
    """

    def __init__(self, seconds: int, superusers: list[int]):
        self.seconds, self.superusers = seconds, set(superusers)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "owner long, opened long, closed boolean")
        self.votes = handle.getMapState("votes", "voter long", "ts long, seq long, choice string")

    def _decides(self, owner: int, voter: int, choice: str) -> bool:
        return choice != "abstain" and (voter == owner or voter in self.superusers)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Keep each voter's first vote; set timers for the end and for each vote that may decide before it."""
        meta = self.meta.get() if self.meta.exists() else None
        if meta and meta[2]:
            return
        owner, opened = (meta[0], meta[1]) if meta else (None, None)
        alarms = set()
        for row in sorted(rows, key=lambda r: (r.ts, r.seq)):
            micros = _micros(row.ts)
            owner = row.owner if owner is None else owner
            if opened is None or micros < opened:
                opened = micros
                alarms.add((opened + self.seconds * 1_000_000 + 999) // 1000)
            if row.choice is None:
                continue
            voter = (row.voter,)
            if self.votes.containsKey(voter):
                old = self.votes.getValue(voter)
                if (old[0], old[1]) <= (micros, row.seq):
                    continue
            self.votes.updateValue(voter, (micros, row.seq, row.choice))
            if self._decides(owner, row.voter, row.choice):
                alarms.add(micros // 1000 + 1)
        if opened is not None:
            self.meta.update((owner, opened, False))
        for alarm in alarms:
            self.handle.registerTimer(alarm)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Close once, if the watermark has passed the end or the deciding vote: count what came up to it, clear the votes."""
        owner, opened, closed = self.meta.get()
        if closed:
            return
        now, end = timerValues.getCurrentWatermarkInMs() * 1000, opened + self.seconds * 1_000_000
        votes = sorted((v[0], v[1], v[2], k[0]) for k, v in self.votes.iterator() if opened <= v[0] < end)
        decision, counts = None, {"agree": 0, "disagree": 0, "abstain": 0}
        for at, _, choice, voter in votes:
            counts[choice] += 1
            if self._decides(owner, voter, choice):
                decision, end = choice, at
                break
        if end > now:
            return
        self.votes.clear()
        self.meta.update((owner, opened, True))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield Row(ballot=key[0], owner=owner, **counts, early=decision is not None, result=decide(counts["agree"], counts["disagree"], decision))

    def close(self) -> None:
        pass


def results(votes: DataFrame, seconds: int, superusers: list[int], delay: str = "1 hour") -> DataFrame:
    """Results of a stream of votes (ballot, owner, voter, choice, ts, seq)."""
    return votes.withWatermark("ts", delay).groupBy("ballot").transformWithState(BallotProcessor(seconds, superusers), StructType.fromDDL(RESULT), "Append", "EventTime")
