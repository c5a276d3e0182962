"""Jobs followed one by one: their steps and whether they are alive, with state and timers.

Each job has a state of its own: when it was first and last heard of, whether it is stale, and which
steps it has done. What a micro-batch brings is written as transitions, once each; a restart from the
checkpoint goes on where the last run ended. Timers tell what happens without an event: a job falls
silent, a step stays out. On the clock of events everything is decided by their times, so the
transitions do not hang on how events were cut into batches; on the clock of processing a job is
heard of when its event arrives, and timers fire in batches without data as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Fixed by the state API: timers need this state store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SCHEMA = "job_id long, kind string, step string, at_ms long, event_id long"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The settings ``STORE`` for the queries that are started inside."""
    before = {k: spark.conf.get(k) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass(frozen=True)
class Step:
    """A step of a job: the codes that pass it and those that pass it with a warning."""

    name: str
    codes: tuple[str, ...]
    warn_codes: tuple[str, ...] = ()


class JobTracker(StatefulProcessor):
    """event_id, ms, job_id, code -> transitions.

    Kinds: pass and warn (a step is done; a warned one may pass later), missing (a job is
    ``missing_ms`` old and a step up to the one after the furthest is not done; it may still be),
    stale (nothing heard for more than ``stale_ms``) and live (heard of again). ``forget_ms`` after a
    job was last heard of its state goes; it is a new job if it comes back.
    """

    def __init__(self, steps: tuple[Step, ...], stale_ms: int, missing_ms: int, forget_ms: int | None = None, by_arrival: bool = False):
        self.steps, self.stale_ms, self.missing_ms, self.forget_ms, self.by_arrival = steps, stale_ms, missing_ms, forget_ms, by_arrival

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "first long, last long, stale boolean, checked boolean, timer long")
        self.done = handle.getMapState("done", "step string", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        if self.by_arrival:
            events["ms"] = timerValues.getCurrentProcessingTimeInMs()
        events = events.sort_values(["ms", "event_id"], kind="stable")
        out: list[tuple] = []
        state = self._read()
        for ms, event, code in zip(events["ms"], events["event_id"], events["code"], strict=True):
            ms = int(ms)
            state = self._due(key[0], state, ms - 1, out)
            if state is None:
                state = {"first": ms, "last": ms, "stale": False, "checked": False, "timer": 0}
            elif state["stale"] and ms > state["last"]:
                state["stale"] = False
                out.append((key[0], "live", None, ms, int(event)))
            state["last"] = max(state["last"], ms)
            self._step(key[0], state, code, ms, int(event), out)
        self._write(state)
        yield pd.DataFrame(out, columns=["job_id", "kind", "step", "at_ms", "event_id"]).astype({"event_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        state = self._read()
        if state is not None and state["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            state["timer"] = 0
            state = self._due(key[0], state, expiredTimerInfo.getExpiryTimeInMs() - 1, out)
            self._write(state)
        yield pd.DataFrame(out, columns=["job_id", "kind", "step", "at_ms", "event_id"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass

    def _read(self) -> dict | None:
        if not self.job.exists():
            return None
        return dict(zip(("first", "last", "stale", "checked", "timer"), self.job.get(), strict=True))

    def _deadlines(self, state: dict) -> list[int]:
        """When the next thing happens without an event; it has when the clock is past it."""
        found = [] if state["stale"] else [state["last"] + self.stale_ms]
        if not state["checked"]:
            found.append(state["first"] + self.missing_ms - 1)
        if self.forget_ms:
            found.append(state["last"] + self.forget_ms)
        return found

    def _write(self, state: dict | None) -> None:
        if state is None:
            return
        wanted = min(self._deadlines(state), default=None)
        wanted = None if wanted is None else wanted + 1
        if wanted != (state["timer"] or None):
            if state["timer"]:
                self.handle.deleteTimer(state["timer"])
            if wanted:
                self.handle.registerTimer(wanted)
            state["timer"] = wanted or 0
        self.job.update((state["first"], state["last"], state["stale"], state["checked"], state["timer"]))

    def _due(self, job: int, state: dict | None, past: int, out: list[tuple]) -> dict | None:
        """What has happened without an event while the clock went to ``past``."""
        if state is None:
            return None
        stale, check = state["last"] + self.stale_ms, state["first"] + self.missing_ms - 1
        happened = []
        if not state["checked"] and check <= past:
            happened.append((check + 1, self._check))
        if not state["stale"] and stale <= past:
            happened.append((stale + 1, self._fall_silent))
        for at, act in sorted(happened, key=lambda x: x[0]):
            act(job, state, at, out)
        if self.forget_ms and state["last"] + self.forget_ms <= past:
            if state["timer"]:
                self.handle.deleteTimer(state["timer"])
            self.job.clear()
            self.done.clear()
            return None
        return state

    def _fall_silent(self, job: int, state: dict, at: int, out: list[tuple]) -> None:
        state["stale"] = True
        out.append((job, "stale", None, at, None))

    def _check(self, job: int, state: dict, at: int, out: list[tuple]) -> None:
        """Mark what is missing of a job that is old enough."""
        state["checked"] = True
        done = dict((k[0], v[0]) for k, v in self.done.iterator())
        furthest = max((i for i, s in enumerate(self.steps) if done.get(s.name) in ("pass", "warn")), default=-1)
        for s in self.steps[: furthest + 2]:
            if s.name not in done:
                self.done.updateValue((s.name,), ("missing",))
                out.append((job, "missing", s.name, at, None))

    def _step(self, job: int, state: dict, code: str, ms: int, event: int, out: list[tuple]) -> None:
        for s in self.steps:
            kind = "pass" if code in s.codes else "warn" if code in s.warn_codes else None
            if kind is None:
                continue
            before = self.done.getValue((s.name,))[0] if self.done.containsKey((s.name,)) else None
            if before == "pass" or (before == "warn" and kind == "warn"):
                continue
            self.done.updateValue((s.name,), (kind,))
            out.append((job, kind, s.name, ms, event))
            if state["checked"]:
                self._check(job, state, ms, out)


def transitions(stream: DataFrame, tracker: JobTracker, late: str = "1 hour") -> DataFrame:
    """The transitions of a stream of event_id, ts, job_id, code; the session needs the settings ``STORE``."""
    rows = stream.select("event_id", "ts", F.unix_millis("ts").alias("ms"), "job_id", "code")
    if not tracker.by_arrival:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=tracker, outputStructType=SCHEMA, outputMode="Append", timeMode="ProcessingTime" if tracker.by_arrival else "EventTime"
    )
