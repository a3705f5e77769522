"""The limits of ``operators.state`` over streams: keyed state between micro-batches.

Event time rules: rows of a key are taken in the order of their time within a micro-batch, and a
row older than the state of its key is taken at the time of that state.  State of a key that
has been idle is dropped after the time-to-live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrykit.operators.state import bucket_step, window_step

OUT = "event_id BIGINT, key STRING, t BIGINT, admitted BOOLEAN, wait_ms BIGINT"


def _prepared(events: DataFrame, key: str, time: str) -> DataFrame:
    ts = F.col(time).cast("timestamp")
    return events.select("event_id", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.unix_millis(ts).alias("t"))


def _stateful(step, idle_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = tuple(state.get) if state.exists else None
        s = s if s and s[1] >= 0 else None
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for i, t in zip(rows.event_id, rows.t):
            at = max(int(t), s[1]) if s else int(t)
            s, ok, wait = step(s, at)
            out.append((i, key[0], t, ok, wait))
        if s is not None:
            state.update((float(s[0]), int(s[1])))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["event_id", "key", "t", "admitted", "wait_ms"])

    return run


def _apply(events: DataFrame, key: str, time: str, step, idle_ms: int) -> DataFrame:
    return (
        _prepared(events, key, time)
        .groupBy("key")
        .applyInPandasWithState(_stateful(step, idle_ms), OUT, "n DOUBLE, at BIGINT", "append", GroupStateTimeout.ProcessingTimeTimeout)
    )


def token_bucket(events: DataFrame, key: str, time: str, capacity: float, window_ms: int, idle_ms: int = 86_400_000) -> DataFrame:
    """Admission of a stream of events by a token bucket for each key."""
    return _apply(events, key, time, lambda s, t: bucket_step(s, t, capacity, window_ms), idle_ms)


def window_counter(events: DataFrame, key: str, time: str, capacity: int, window_ms: int, idle_ms: int = 86_400_000) -> DataFrame:
    """Admission of a stream of events by a ceiling in each window of a key."""
    return _apply(events, key, time, lambda s, t: window_step(s, t, capacity, window_ms), idle_ms)


def counts_by_window(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events of each window of event time and key; rows later than the watermark are dropped by the engine."""
    e = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width), *keys).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "events")
