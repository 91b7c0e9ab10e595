"""Upload jobs as state: each job's events move it on, and a timer takes it back when its worker is silent.

Events are submit, claim, beat (the worker is alive), done, fail and cancel.
A claimed job that is neither heard of nor done for ``stale`` seconds of event
time goes back to pending with one more retry, and fails once they are spent; a
failed attempt does the same at once. What the batch functions of
``operators.jobs`` do to a table, this does to a stream of any length: state is
keyed by job, so jobs are spread over all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE_SECONDS, MAX_RETRIES = 3600, 2
#: The store that keeps state with timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "job_id string, at timestamp, event string, status string, retries int, attempts int"


class Jobs(StatefulProcessor):
    """Status, retries and attempts of one job."""

    def __init__(self, stale_seconds: int = STALE_SECONDS, max_retries: int = MAX_RETRIES):
        self.stale_ms, self.max_retries = stale_seconds * 1000, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, retries int, attempts int, deadline long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["at", "event"], kind="stable")
        out = []
        for at, event in zip(events["at"], events["event"], strict=True):
            before = self.job.get() if self.job.exists() else None
            after = self._step(before, event, int(at.timestamp() * 1000))
            if after is None:
                continue
            if after != before:
                self._keep(before, after)
            if before is None or after[:3] != before[:3]:
                out.append((key[0], at, event, *after[:3]))
        yield pd.DataFrame(out, columns=["job_id", "at", "event", "status", "retries", "attempts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.job.exists():
            before = self.job.get()
            if before[0] == "processing" and before[3] == at:
                after = self._again(before)
                self._keep(before, after)
                yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), "silent", *after[:3])], columns=["job_id", "at", "event", "status", "retries", "attempts"])

    def _again(self, job: tuple) -> tuple:
        """After a lost attempt: pending with one more retry, or failed."""
        _, retries, attempts, _ = job
        return ("failed", retries, attempts, 0) if retries >= self.max_retries else ("pending", retries + 1, attempts, 0)

    def _step(self, job: tuple | None, event: str, at: int) -> tuple | None:
        """The job after an event; null for one that no job has or that changes nothing."""
        if job is None:
            return ("pending", 0, 0, 0) if event == "submit" else None
        status, retries, attempts, _ = job
        if status == "pending" and event == "claim":
            return ("processing", retries, attempts + 1, at + self.stale_ms)
        if status == "processing" and event == "beat":
            return ("processing", retries, attempts, at + self.stale_ms)
        if status == "processing" and event == "done":
            return ("completed", retries, attempts, 0)
        if status == "processing" and event == "fail":
            return self._again(job)
        if status in ("pending", "processing") and event == "cancel":
            return ("cancelled", retries, attempts, 0)
        return None

    def _keep(self, before: tuple | None, after: tuple) -> None:
        if before is not None and before[3]:
            self.handle.deleteTimer(before[3])
        if after[3]:
            self.handle.registerTimer(after[3])
        # An ended job keeps its state, so that late events find it ended.
        self.job.update(after)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, stale_seconds: int = STALE_SECONDS, max_retries: int = MAX_RETRIES, delay: str = "0 seconds") -> DataFrame:
    """Every change of every job of a stream of events (job_id, event, at): job_id, at, event, status, retries, attempts.

    Events that don't fit a job's status change nothing. The session needs
    ``STORE``. A batch's events of one job are taken by time, then by name.
    """
    return (
        events.withWatermark("at", delay)
        .groupBy("job_id")
        .transformWithStateInPandas(statefulProcessor=Jobs(stale_seconds, max_retries), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
    )
