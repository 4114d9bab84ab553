"""Dialogs of several turns: a request waits for the user's next usable message.

A message that is no usable name is asked for again; a usable one or a cancellation ends the dialog, and so does another
request, which begins a new one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

DIALOG = "user_id long, asked_seq long, answer_seq long, outcome string, prompts long"


# Spark asks the processor for its state before executors start, in a process without shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class DialogProcessor(StatefulProcessor):
    """Input rows: user_id, kind (request, name, unusable, cancel), ts, seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "asked long, prompts long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Turns in order of their time; one row for each dialog that ends."""
        asked, prompts = self.open.get() if self.open.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: (r.ts, r.seq)):
            if asked is not None and row.kind == "unusable":
                prompts += 1
                continue
            if asked is not None:
                outcome = {"name": "renamed", "cancel": "cancelled", "request": "asked_again"}[row.kind]
                yield Row(user_id=key[0], asked_seq=asked, answer_seq=row.seq, outcome=outcome, prompts=prompts)
                asked = None
            if row.kind == "request":
                asked, prompts = row.seq, 1
        if asked is None:
            self.open.clear()
        else:
            self.open.update((asked, prompts))

    def close(self) -> None:
        pass


def dialogs(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """How each dialog ended (renamed, cancelled, asked_again) and how often the user was prompted."""
    return messages.withWatermark("ts", delay).groupBy("user_id").transformWithState(DialogProcessor(), StructType.fromDDL(DIALOG), "Append", "EventTime")
