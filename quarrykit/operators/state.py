"""Keyed request state: token buckets, window counters, caches, cooldown and composite admission.

Each is one pure step function; batches fold it over the ordered events of a key, streams keep
its state between micro-batches (``quarrykit.streaming.limits``).  Times are milliseconds.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- steps
def bucket_step(state: tuple[float, int] | None, t: int, capacity: float, window_ms: int) -> tuple[tuple[float, int], bool, int]:
    """Token bucket: full at first, refilled evenly; returns the new state, whether admitted, and the wait."""
    rate = capacity / window_ms
    tokens = capacity if state is None else min(capacity, state[0] + (t - state[1]) * rate)
    if tokens >= 1:
        return (tokens - 1, t), True, 0
    return (tokens, t), False, math.ceil((1 - tokens) / rate)


def window_step(state: tuple[int, int] | None, t: int, capacity: int, window_ms: int) -> tuple[tuple[int, int], bool, int]:
    """Window counter: a window opens at the first event after the last one ended; at most ``capacity`` in each."""
    if state is None or t - state[1] >= window_ms:
        state = (0, t)
    if state[0] < capacity:
        return (state[0] + 1, state[1]), True, 0
    return state, False, state[1] + window_ms - t


@dataclass
class Admission:
    """Composite admission of one route over one ordered stream: cooldown, client bucket, global bucket, day, client's day.

    A later refusal gives back what earlier checks had taken.
    """

    client: tuple[float, int] = (1, 120_000)
    everyone: tuple[float, int] = (2, 120_000)
    per_day: tuple[int, int] | None = (25, 86_400_000)
    client_day: tuple[int, int] | None = (8, 86_400_000)
    most_keys: int = 5_000
    cooldown_until: int = 0
    buckets: OrderedDict = field(default_factory=OrderedDict)
    shared: tuple[float, int] | None = None
    day: tuple[int, int] | None = None
    days: OrderedDict = field(default_factory=OrderedDict)

    def _keep(self, d: OrderedDict, key, value) -> None:
        d[key] = value
        d.move_to_end(key)
        while len(d) > self.most_keys:
            d.popitem(last=False)

    def _refund(self, key) -> None:
        if key is not None and key in self.buckets:
            n, at = self.buckets[key]
            self.buckets[key] = (min(self.client[0], n + 1), at)

    def take(self, key, t: int) -> tuple[str, int]:
        """(outcome, wait): admitted, model_cooldown, rate_limited, busy, daily_limit or client_daily_limit."""
        if self.cooldown_until > t:
            return "model_cooldown", self.cooldown_until - t
        if key is not None:
            s, ok, wait = bucket_step(self.buckets.get(key), t, *self.client)
            self._keep(self.buckets, key, s)
            if not ok:
                return "rate_limited", wait
        self.shared, ok, wait = bucket_step(self.shared, t, *self.everyone)
        if not ok:
            self._refund(key)
            return "busy", wait
        if self.per_day:
            self.day, ok, wait = window_step(self.day, t, *self.per_day)
            if not ok:
                self._refund(key)
                self.shared = (min(self.everyone[0], self.shared[0] + 1), self.shared[1])
                return "daily_limit", wait
        if self.client_day and key is not None:
            s, ok, wait = window_step(self.days.get(key), t, *self.client_day)
            self._keep(self.days, key, s)
            if not ok:
                self._refund(key)
                self.shared = (min(self.everyone[0], self.shared[0] + 1), self.shared[1])
                self.day = (max(0, self.day[0] - 1), self.day[1])
                return "client_daily_limit", wait
        return "admitted", 0

    def cool_down(self, t: int, wait: int | None) -> None:
        if wait and wait > 0:
            self.cooldown_until = max(self.cooldown_until, t + wait)


# ---- batches
def fold_keys(events: DataFrame, key: str, step: Callable, schema: str = "admitted BOOLEAN, wait_ms BIGINT") -> DataFrame:
    """Folds a step over the events of each key, in the order of (t, event_id).

    events: event_id, key, t.  Rows are clustered by key and sorted within the partition, and folded as a
    stream, so a key of any number of events is never held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, first = None, None, True
        for b in batches:
            rows = []
            for i, k, t in zip(b.event_id, b.key, b.t):
                k = None if pd.isna(k) else k
                if first or k != current:
                    current, state, first = k, None, False
                state, ok, wait = step(state, int(t))
                rows.append((i, k, t, ok, wait))
            yield pd.DataFrame(rows, columns=["event_id", "key", "t", "admitted", "wait_ms"])

    e = events.select("event_id", F.col(key).cast("string").alias("key"), "t")
    return e.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, f"event_id BIGINT, key STRING, t BIGINT, {schema}")


def token_bucket(events: DataFrame, key: str, capacity: float, window_ms: int) -> DataFrame:
    return fold_keys(events, key, lambda s, t: bucket_step(s, t, capacity, window_ms))


def window_counter(events: DataFrame, key: str, capacity: int, window_ms: int) -> DataFrame:
    return fold_keys(events, key, lambda s, t: window_step(s, t, capacity, window_ms))


def in_flight(events: DataFrame, start: str, end: str, bucket_ms: int = 3_600_000) -> DataFrame:
    """Requests in flight after every moment at which any starts or ends: t, open.

    A sweep in two levels: moments are summed, then running sums are taken inside buckets of time and
    over the few bucket totals, so no task orders all events.
    """
    ticks = events.select(F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(events.select(F.col(end).alias("t"), F.lit(-1).alias("d")))
    per = ticks.groupBy("t").agg(F.sum("d").alias("net")).withColumn("bucket", F.floor(F.col("t") / bucket_ms))
    totals = per.groupBy("bucket").agg(F.sum("net").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).alias("before"))
    w = Window.partitionBy("bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.join(before, "bucket").select("t", (F.col("before") + F.sum("net").over(w)).alias("open"))


def cooldown_until(t: Column, wait: Column, partition: list[Column | str]) -> Column:
    """Until when requests are refused: the largest t + wait so far."""
    w = Window.partitionBy(*partition).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.max(F.when(wait > 0, t + wait)).over(w)


class LruBytes:
    """Cache bounded by bytes; an entry costs its size and 64; the newest always stays."""

    def __init__(self, most: int):
        self.most, self.held, self.evictions, self.entries = most, 0, 0, OrderedDict()

    def get(self, key):
        if key in self.entries:
            self.entries.move_to_end(key)
            return self.entries[key]
        return None

    def put(self, key, size: int) -> None:
        if key in self.entries:
            self.held -= self.entries.pop(key)
        self.entries[key] = size + 64
        self.held += size + 64
        while self.held > self.most and len(self.entries) > 1:
            _, cost = self.entries.popitem(last=False)
            self.held -= cost
            self.evictions += 1


def lru_cache_run(events: DataFrame, partition: str, key: str, size: str, most: int) -> DataFrame:
    """Hits, misses and evictions of one byte-bounded cache for each partition over its ordered events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, cache, hits, misses, out, first = None, None, 0, 0, [], True
        for b in batches:
            for p, k, n in zip(b["p"], b["k"], b["n"]):
                if first or p != cur:
                    if not first:
                        out.append((cur, hits, misses, cache.evictions, cache.held))
                    cur, cache, hits, misses, first = p, LruBytes(most), 0, 0, False
                if cache.get(k) is None:
                    misses += 1
                    cache.put(k, int(n))
                else:
                    hits += 1
        if not first:
            out.append((cur, hits, misses, cache.evictions, cache.held))
        yield pd.DataFrame(out, columns=["p", "hits", "misses", "evictions", "held"])

    e = events.select(F.col(partition).cast("string").alias("p"), F.col(key).cast("string").alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"), "t", "event_id")
    return e.repartition("p").sortWithinPartitions("p", "t", "event_id").mapInPandas(run, "p STRING, hits BIGINT, misses BIGINT, evictions BIGINT, held BIGINT")


def ttl_hits(events: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """Whether a request finds an entry that is younger than its life; a miss stores anew."""

    def step(state, t):
        if state is not None and t - state < ttl_ms:
            return state, True, state + ttl_ms - t
        return t, False, 0

    return fold_keys(events, key, step)


def admission(events: DataFrame, key: str, make: Callable[[], Admission] = Admission) -> DataFrame:
    """Composite admission over one ordered stream; by nature one task, as the limits are shared by all keys.

    Only event id, key and time are read; the rows are folded as they come and none is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = make()
        for b in batches:
            got = [a.take(None if pd.isna(k) else k, int(t)) for k, t in zip(b.key, b.t)]
            yield pd.DataFrame({"event_id": b.event_id, "outcome": [g[0] for g in got], "wait_ms": [g[1] for g in got]})

    e = events.select("event_id", F.col(key).cast("string").alias("key"), "t")
    return e.repartition(1).sortWithinPartitions("t", "event_id").mapInPandas(run, "event_id BIGINT, outcome STRING, wait_ms BIGINT")


def retained(objects: DataFrame, partition: list[str], order: list[Column], size: str, most: int) -> DataFrame:
    """What a size-bounded store keeps: newest first while the running size fits, the newest always."""
    w = Window.partitionBy(*partition).orderBy(*order)
    o = objects.withColumn("r", F.row_number().over(w)).withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return o.where((F.col("running") <= most) | (F.col("r") == 1)).drop("r", "running")


def retry_after_seconds(ms: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(ms / 1000)).cast("bigint")
