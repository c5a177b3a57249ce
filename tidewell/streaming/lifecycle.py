"""The document lifecycle as a stateful stream: claims, leases, retries.

State is one row per document (status, attempts, started). Each input row asks for a transition at
its time; what the rules forbid is rejected and changes nothing. A claim whose lease has run out can
be claimed again. The transitions that were made, and those that were refused, are the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "id STRING, ts TIMESTAMP, action STRING, before STRING, after STRING, attempts INT, accepted BOOLEAN"


class Lifecycle(StatefulProcessor):
    """Rows: id, ts, action (create, claim, ready, fail). Transitions are those of the batch operators."""

    def __init__(self, lease_seconds: int = 600):
        self.lease_ms = 1000 * lease_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", "status STRING, attempts INT, started LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, started = self.state.get() if self.state.exists() else ("", 0, 0)
        events = pd.concat(rows).sort_values("ts", kind="stable")
        out = []
        for action, ts in zip(events["action"], events["ts"]):
            ms, before = int(ts.timestamp() * 1000), status
            free = status in ("PENDING", "FAILED") or status == "PROCESSING" and started < ms - self.lease_ms
            if action == "create" and not status:
                status = "PENDING"
            elif action == "claim" and free:
                status, attempts, started = "PROCESSING", attempts + 1, ms
            elif action in ("ready", "fail") and status == "PROCESSING":
                status = "READY" if action == "ready" else "FAILED"
            else:
                out.append((key[0], ts, action, before, before, attempts, False))
                continue
            out.append((key[0], ts, action, before, status, attempts, True))
        if status:
            self.state.update((status, attempts, started))
        yield pd.DataFrame(out, columns=["id", "ts", "action", "before", "after", "attempts", "accepted"])

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, lease_seconds: int = 600) -> DataFrame:
    """Transitions of the streaming rows id, ts, action; needs the RocksDB state store."""
    return events.groupBy("id").transformWithStateInPandas(Lifecycle(lease_seconds), outputStructType=OUTPUT, outputMode="append", timeMode="none")


class Leases(Lifecycle):
    """The same, on event time: a timer ends a claim whose lease runs out without a result, and the document is pending again."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, rows, timerValues)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if self.state.exists() and self.state.get()[0] == "PROCESSING":
            self.handle.registerTimer(self.state.get()[2] + self.lease_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, started = self.state.get() if self.state.exists() else ("", 0, 0)
        if status == "PROCESSING":
            self.state.update(("PENDING", attempts, 0))
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame([(key[0], at, "lease_expired", status, "PENDING", attempts, True)], columns=["id", "ts", "action", "before", "after", "attempts", "accepted"])


def leases(events: DataFrame, lease_seconds: int = 600) -> DataFrame:
    """Transitions, with leases ended by timers; events need a watermark on ts."""
    return events.groupBy("id").transformWithStateInPandas(
        Leases(lease_seconds), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
    )
