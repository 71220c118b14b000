"""Streams over task events and panes: changes of state, waits with a deadline, live rollups and dashboards, and windows.

The window and session functions at the end are Spark's own additions to the set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from quarry.operators.lifecycle import TERMINAL, WAITING, dashboard, rollup, wants_approval
from quarry.sources.files import repositories


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("needs_input", "needs_input boolean")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values("ts")
        before = self.last.get()[0] if self.last.exists() else False
        out = []
        for ts, now in zip(all_rows["ts"], all_rows["now"]):
            if bool(now) != bool(before):
                out.append((key[0], ts, bool(now)))
                before = bool(now)
        self.last.update((bool(before),))
        yield pd.DataFrame(out, columns=["id", "ts", "needs_input"])

    def close(self) -> None:
        pass


def input_changes(panes: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """(id, ts, needs_input) whenever a pane's need for input changes; panes: (id, ts, tail). Needs the RocksDB state
    store."""
    marked = panes.select("id", "ts", wants_approval(F.col("tail"), patterns).alias("now"))
    return marked.groupBy("id").transformWithStateInPandas(statefulProcessor=_Changes(), outputStructType="id long, ts timestamp, needs_input boolean", outputMode="append", timeMode="none")


def latest_status(events: DataFrame) -> DataFrame:
    """(id, status, ts) of the last event of each task; for update or complete mode."""
    return events.groupBy("id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def terminal(events: DataFrame) -> DataFrame:
    """Events of tasks that came to an end: what a waiting caller watches for."""
    return events.filter(F.col("status").isin(*TERMINAL))


#: Seconds that a caller waits if it doesn't say, and at most.
WAIT_SECONDS, LONGEST_WAIT = 1800, 3600
_WAITED = "id long, outcome string, status string, waited_ms long"


class _Wait(StatefulProcessor):
    """One task: its last status, and since when and until when someone waits for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")
        self.waiting = handle.getValueState("waiting", "since long, until long")

    def _told(self, key, outcome: str, status: str | None, now: int) -> pd.DataFrame:
        since, until = self.waiting.get()
        self.waiting.clear()
        self.handle.deleteTimer(until)
        return pd.DataFrame({"id": [key[0]], "outcome": [outcome], "status": [status], "waited_ms": [now - since]})

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        every = pd.concat(list(rows)).sort_values("ts", kind="stable")
        status = self.status.get()[0] if self.status.exists() else None
        known = every.loc[every["status"].notna(), "status"]
        status = known.iloc[-1] if len(known) else status
        if status is not None:
            self.status.update((status,))
        asked = every.loc[every["timeout"].notna(), "timeout"]
        if len(asked) and not self.waiting.exists():
            seconds = int(asked.iloc[0])
            until = now + 1000 * min(seconds if seconds > 0 else WAIT_SECONDS, LONGEST_WAIT)
            self.waiting.update((now, until))
            self.handle.registerTimer(until)
        if status in TERMINAL and self.waiting.exists():
            yield self._told(key, "ended", status, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            status = self.status.get()[0] if self.status.exists() else None
            yield self._told(key, "timeout", status, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def waited(events: DataFrame) -> DataFrame:
    """(id, outcome, status, waited_ms): one row for each wait, once the task is done, failed, rejected or interrupted, or
    once its time is up by the clock. events: (id, ts, status, timeout), of which status tells a change, and timeout, in
    seconds, begins a wait; 0 or less is WAIT_SECONDS, and none is longer than LONGEST_WAIT. A second wait for a task that
    is waited for already is the first. Needs the RocksDB state store."""
    return events.groupBy("id").transformWithStateInPandas(statefulProcessor=_Wait(), outputStructType=_WAITED, outputMode="append", timeMode="ProcessingTime")


#: The shortest time between two ticks of a dashboard.
LEAST_TICK = 0.5


def watch(ticks: DataFrame, registry: Callable[[], DataFrame], tasks_of: Callable[[str, str], DataFrame], show: Callable[[DataFrame, DataFrame], None], seconds: float = 2.0) -> DataStreamWriter:
    """A dashboard that is made anew at each micro-batch of ticks, at least LEAST_TICK apart. registry() reads the entries
    (name, path, ...) again each time, so that a repository added or taken away meanwhile shows; tasks_of(name, path)
    reads the tasks of one. show() gets the counts over all repositories, and the tasks in their order with repo. A
    repository that can't be read is left out of that tick; a registry that can't be read keeps its last entries."""
    last: list[tuple[str, str]] = []

    def tick(_: DataFrame, __: int) -> None:
        nonlocal last
        try:
            last = sorted((r["name"], r["path"]) for r in registry().select("name", "path").collect())
        except Exception:  # being replaced just now
            pass
        found = {}
        for name, path in last:
            try:
                found[name] = tasks_of(name, path)
                found[name].schema  # noqa: B018  that it is there
            except Exception:  # not there, or not yet
                found.pop(name, None)
        if found:
            whole = repositories(found)
            show(rollup(whole), dashboard(whole))

    return ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{max(seconds, LEAST_TICK)} seconds")


def live_rollup(events: DataFrame) -> DataFrame:
    """Counts by repo of task events; for complete mode."""
    s = F.col("status")
    return events.groupBy("repo").agg(F.count("*").alias("total"), F.count_if(s == "executing").alias("executing"), F.count_if(s.isin(*WAITING)).alias("pending"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
