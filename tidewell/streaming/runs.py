"""Runs as streams with state: attempts with fencing, live timelines, retention of events, the periodic sweep."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.lifecycle import Policy

TRANSITION = "run_id STRING, ts TIMESTAMP, action STRING, attempt INT, before STRING, after STRING, children INT, accepted BOOLEAN, reason STRING"
_TRANSITION = [x.strip().split()[0] for x in TRANSITION.split(",")]


class Runs(StatefulProcessor):
    """Rows: run_id, ts, action, attempt, step. State: the run (status, attempts, started) and the children of its present attempt.

    create makes a run PENDING; claim starts the next attempt of a PENDING run, or of a RUNNING one
    whose lease has run out, and clears what the attempt before it wrote; step, succeed and fail count
    only from the present attempt of a RUNNING run. What is refused changes nothing, and its reason is given:
    missing, exists, terminal, held (claimed, lease not over), stale (another attempt), idle (not running).
    """

    def __init__(self, lease_seconds: int):
        self.lease_ms = 1000 * lease_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "status STRING, attempts INT, started LONG, children INT")
        self.children = handle.getMapState("children", "step INT", "at LONG")

    def refused(self, action: str, attempt, now: int, status: str, attempts: int, started: int) -> str | None:
        if action == "create":
            return "exists" if status else None
        if not status:
            return "missing"
        if status in ("SUCCEEDED", "FAILED"):
            return "terminal"
        if action == "claim":
            return "held" if status == "RUNNING" and started >= now - self.lease_ms else None
        return "idle" if status != "RUNNING" else None if attempt == attempts else "stale"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, started, children = self.run.get() if self.run.exists() else ("", 0, 0, 0)
        asked = pd.concat(rows).sort_values("ts", kind="stable")
        out = []
        for ts, action, attempt, step in zip(asked["ts"], asked["action"], asked["attempt"], asked["step"]):
            now, before = int(ts.timestamp() * 1000), status
            reason = self.refused(action, attempt, now, status, attempts, started)
            if reason is None:
                if action == "create":
                    status = "PENDING"
                elif action == "claim":
                    status, attempts, started, children = "RUNNING", attempts + 1, now, 0
                    self.children.clear()
                elif action == "step":
                    children += not self.children.containsKey((int(step),))
                    self.children.updateValue((int(step),), (now,))
                else:
                    status = "SUCCEEDED" if action == "succeed" else "FAILED"
            out.append((key[0], ts, action, attempts, before, status, children, reason is None, reason))
        if status:
            self.run.update((status, attempts, started, children))
        yield pd.DataFrame(out, columns=_TRANSITION)

    def close(self) -> None:
        pass


def runs(requests: DataFrame, lease_seconds: int = Policy().run_lease) -> DataFrame:
    """Each request with what it did, in the order of each run's times."""
    return requests.groupBy("run_id").transformWithStateInPandas(Runs(lease_seconds), outputStructType=TRANSITION, outputMode="append", timeMode="none")


CHANGE = "run_id STRING, attempt INT, step_number INT, data STRING, gone BOOLEAN, ms LONG, seq LONG"
_CHANGE = [x.strip().split()[0] for x in CHANGE.split(",")]


class Timeline(StatefulProcessor):
    """Rows: run_id, ms, seq, event, step_number, data. State: the last event of each step of the present attempt; run.started clears it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempt = handle.getValueState("attempt", "n INT")
        self.steps = handle.getMapState("steps", "step INT", "ms LONG, seq LONG, data STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state is a message to the executor: one reads it, and only what is left at the end is written
        old = self.attempt.exists()
        attempt = self.attempt.get()[0] if old else 0
        came = pd.concat(rows).sort_values(["ms", "seq"], kind="stable")
        changed: dict[int, tuple] = {}
        known = {k[0] for k in self.steps.keys()} if old else set()
        cleared = False
        for ms, seq, event, step, data in zip(came["ms"], came["seq"], came["event"], came["step_number"], came["data"]):
            if event == "run.started":
                attempt += 1
                changed = {s: (key[0], attempt, s, None, True, int(ms), int(seq)) for s in known | changed.keys()}  # also where two attempts begin at once
                known, cleared = set(), True
            elif event == "step.completed":
                known.add(int(step))
                changed[int(step)] = (key[0], attempt, int(step), data, False, int(ms), int(seq))
        self.attempt.update((attempt,))
        if cleared and old:
            self.steps.clear()
        for step, x in changed.items():
            if not x[4]:
                self.steps.updateValue((step,), (x[5], x[6], x[3]))
        if changed:
            yield pd.DataFrame(list(changed.values()), columns=_CHANGE)

    def close(self) -> None:
        pass


def timeline(events: DataFrame) -> DataFrame:
    """The steps that each batch changes, in update mode: new contents, or gone where a new attempt has cleared them."""
    return events.groupBy("run_id").transformWithStateInPandas(Timeline(), outputStructType=CHANGE, outputMode="update", timeMode="none")


KEPT = "run_id STRING, id STRING, gone BOOLEAN"


class Newest(StatefulProcessor):
    """Rows: run_id, ms, seq, id. State: the ids of a run's newest `most` events, which lives for `hours` after the last one; an event after a longer silence begins anew."""

    def __init__(self, most: int, hours: int):
        self.most, self.ttl = most, hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "ms LONG, seq LONG, id STRING")
        self.last = handle.getValueState("last", "ms LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(rows)
        old = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        new = [(int(a), int(b), c) for a, b, c in zip(came["ms"], came["seq"], came["id"])]
        everything = sorted({*old, *new})
        silent = [i for i in range(1, len(everything)) if everything[i][0] - everything[i - 1][0] > self.ttl]
        kept = everything[silent[-1] if silent else 0 :][-self.most :]
        self.kept.put(kept)
        last = kept[-1][0]
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.ttl + 1)
        before, after = {x[2] for x in old}, {x[2] for x in kept}
        out = [(key[0], x, False) for x in sorted(after - before)] + [(key[0], x, True) for x in sorted(before - after)]
        yield pd.DataFrame(out, columns=["run_id", "id", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.ttl < expiredTimerInfo.getExpiryTimeInMs():
            out = [(key[0], x[2], True) for x in self.kept.get()]
            self.kept.clear()
            self.last.clear()
            yield pd.DataFrame(out, columns=["run_id", "id", "gone"])

    def close(self) -> None:
        pass


def retention(events: DataFrame, most: int = 1000, hours: int = 24) -> DataFrame:
    """What retention keeps and drops, as changes; events need a watermark on their time, which ends silent runs."""
    return events.groupBy("run_id").transformWithStateInPandas(Newest(most, hours), outputStructType=KEPT, outputMode="append", timeMode="EventTime")


class Sweeper:
    """Sweeps at an interval: the first at once, one at a time, each with a deadline as long as the interval.

    A sweep that overruns its deadline has its jobs cancelled and counts as late; ticks that pass meanwhile are dropped, not made up for.
    """

    def __init__(self, spark: SparkSession, sweep: Callable[[int], None], interval: float = Policy().interval):
        self.spark, self.sweep, self.interval = spark, sweep, interval
        self.done, self.late, self.failed = [], [], []
        self._busy = threading.Lock()

    def tick(self, n: int) -> None:
        if not self._busy.acquire(blocking=False):
            return
        tag = f"tidewell-sweep-{id(self)}-{n}"
        began = time.monotonic()
        timer = threading.Timer(self.interval, self.spark.sparkContext.cancelJobsWithTag, [tag])
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            self.sweep(n)
            (self.done if time.monotonic() - began <= self.interval else self.late).append(n)
        except Exception as e:
            if time.monotonic() - began >= self.interval:
                self.late.append(n)
            else:
                self.failed.append((n, str(e)))
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
            self._busy.release()

    def start(self, checkpoint: str):
        """A streaming query whose trigger is the interval; each batch is one tick."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def write(batch: DataFrame, batch_id: int) -> None:
            self.tick(batch_id)

        return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{self.interval} seconds").start()
