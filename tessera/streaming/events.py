"""Event streams: windows with watermarks, scope filters and throttling with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event time with a watermark; a timestamp without zone is cast first."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hourly_counts(stream: DataFrame) -> DataFrame:
    return timed(stream).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    return timed(stream).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def in_scope(stream: DataFrame, user_id: int | None) -> DataFrame:
    """Everything without a scope; else the user's events and those of nobody."""
    return stream if user_id is None else stream.where(F.col("user_id").isNull() | (F.col("user_id") == user_id))


def throttled(stream: DataFrame, seconds: float = 0.4, always: str = "error") -> DataFrame:
    """Events at least ``seconds`` after the last one passed on for the user; those of type ``always`` pass.

    The state is one number a user.  Within a batch a user's events are taken in order of time.
    """
    schema = "user_id long, event_id long, event_type string, ts timestamp"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else float("-inf")
        keep = []
        for kind, at in zip(rows["event_type"], rows["ts"].map(pd.Timestamp.timestamp), strict=True):
            due = at - last >= seconds
            keep.append(due or kind == always)
            last = at if due else last
        state.update((last,))
        yield rows[keep][["user_id", "event_id", "event_type", "ts"]]

    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "event_type", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(fold, schema, "last double", "append", GroupStateTimeout.NoTimeout)
