"""Jobs as keyed state: the last state of each, a timer for jobs that fall silent, and one for finished ones to be forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: states after which a job has ended
FINISHED = ("done", "failed")
#: what the stream tells of a job: its state, when that began, and whether a timer said so
CHANGES = "job string, state string, at timestamp, seq long, by_timer boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobStates(StatefulProcessor):
    """Keeps (state, at, seq) of a job. Events count in the order of seq: one that is late or repeated changes nothing.

    A running job has a timer at its last sign of life plus `silent` seconds; when the watermark passes it, the job has failed. A finished job has one at its
    end plus `ttl` seconds, after which nothing of it is kept. Timers are in event time, so a stream that is run again tells the same.
    """

    def __init__(self, silent: float, ttl: float) -> None:
        self.silent, self.ttl = silent, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, at long, seq long")

    def _due(self, state: str, at: int) -> int:
        return at + int(1000 * (self.ttl if state in FINISHED else self.silent))

    def _set(self, state: str, at: int, seq: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((state, at, seq))
        self.handle.registerTimer(self._due(state, at))

    def _told(self, key: tuple, state: str, at: int, seq: int, by_timer: bool) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "state": [state], "at": [pd.Timestamp(at, unit="ms")], "seq": [seq], "by_timer": [by_timer]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        best = None
        for batch in rows:
            own = batch.loc[batch["seq"].idxmax()]
            if best is None or own["seq"] > best["seq"]:
                best = own
        if best is not None and (known is None or best["seq"] > known[2]):
            state, at, seq = str(best["state"]), int(best["at"].value // 1_000_000), int(best["seq"])
            self._set(state, at, seq)
            yield self._told(key, state, at, seq, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        state, at, seq = self.last.get()
        due = self._due(state, at)
        if expiredTimerInfo.getExpiryTimeInMs() < due:  # a timer of an earlier state
            return
        if state in FINISHED:
            self.last.clear()
        else:
            self._set("failed", due, seq)
            yield self._told(key, "failed", due, seq, True)

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, silent: str = "600 seconds", ttl: str = "3600 seconds", lateness: str = "60 seconds") -> DataFrame:
    """A stream of CHANGES for a stream of events (job, state, at, seq): a row for each batch in which a job has a newer state, and one when a job that is not finished
    has given no sign for `silent`, which makes it failed at that time. Finished jobs are forgotten after `ttl`. Intervals are in seconds. Events later than
    `lateness` are dropped. For append or update output; needs use_job_state() before the stream starts."""
    seconds = lambda text: float(text.split()[0])
    timed = events.select("job", "state", "at", "seq").withWatermark("at", lateness)
    return timed.groupBy("job").transformWithStateInPandas(JobStates(seconds(silent), seconds(ttl)), CHANGES, "update", "EventTime")


def use_job_state(spark: SparkSession) -> None:
    """State of a job lives in RocksDB on the executors, checkpointed with the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
