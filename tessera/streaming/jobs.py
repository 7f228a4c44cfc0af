"""Jobs followed on a stream: accepted and refused events, and a heartbeat where a job is silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.lifecycle import ACTIONS, allowed

OUTPUT = "job long, event_id long, ts timestamp, action string, before string, after string, outcome string"


class JobFollower(StatefulProcessor):
    """One value a job: its state, its starts and when it was last heard of, in milliseconds.

    Within a batch events are taken in order of time, then id.  One that is older than the last one taken is ``late`` and changes
    nothing; one that the state does not allow is ``refused``.  A timer runs ``idle_ms`` after the last event; when it ends, a
    ``heartbeat`` with the state goes out and the next timer runs, until the job is settled.
    """

    def __init__(self, idle_ms: int, event_time: bool, ttl_ms: int | None):
        self.idle_ms, self.event_time, self.ttl_ms = idle_ms, event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "state string, starts int, seen long", self.ttl_ms)

    def _again(self, after: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(after + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state, starts, seen = self.state.get() if self.state.exists() else ("queued", 0, -(1 << 62))
        out = []
        for event_id, ts, action in zip(batch["event_id"], batch["ts"], batch["action"], strict=True):
            at, before = ts.value // 1_000_000, state
            if at < seen:
                outcome = "late"
            elif (after := allowed(state, starts, action)) is None:
                outcome, seen = "refused", at
            else:
                outcome, seen, state, starts = "accepted", at, after, starts + (action == "claim")
            out.append((key[0], event_id, ts, action, before, state, outcome))
        self.state.update((state, starts, seen))
        self._again(seen if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["job", "event_id", "ts", "action", "before", "after", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state, due = self.state.get()[0], expiredTimerInfo.getExpiryTimeInMs()
        if state in ("queued", "running", "cancelling"):
            # a watermark that jumps ahead ends many intervals at once: one heartbeat stands for them
            now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(max(due, now) + self.idle_ms)
        yield pd.DataFrame({"job": [key[0]], "event_id": pd.array([None], dtype="Int64"), "ts": [pd.Timestamp(due, unit="ms")], "action": ["heartbeat"], "before": [state], "after": [state], "outcome": ["heartbeat"]})

    def close(self) -> None:
        pass


def followed(stream: DataFrame, idle_ms: int = 15_000, late: str | None = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """job, event_id, ts, action, before, after, outcome of ``stream`` (job, event_id, ts, action).

    ``late`` is the delay of the watermark, which then is the clock of the timers; without it the clock is that of the machine, and a
    job's state may end ``ttl_ms`` after it was last written.  Needs the RocksDB state store.  Rows without a job, a time or a known
    action are left out.
    """
    if late is not None and ttl_ms is not None:
        raise ValueError("state ends by the machine's clock: ttl_ms goes with late=None")
    rows = stream.select("job", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action").where(F.col("job").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin(ACTIONS))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("job").transformWithStateInPandas(JobFollower(idle_ms, late is not None, ttl_ms), OUTPUT, "append", "EventTime" if late is not None else "ProcessingTime")
