"""Queries of keyed request state over the event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrykit.operators import state as S
from quarrykit.session import table

DAY = 86_400_000


def events(s, d):
    e = table(s, d, "events").dropDuplicates(["event_id"])
    return e.withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))


def _bucket(s, d):
    return S.token_bucket(events(s, d), "user_id", 2, DAY).select("event_id", "admitted", "wait_ms")


def _window(s, d):
    return S.window_counter(events(s, d), "user_id", 3, 2 * DAY).select("event_id", "admitted", "wait_ms")


def _ttl(s, d):
    return S.ttl_hits(events(s, d), "user_id", DAY).select("event_id", F.col("admitted").alias("hit"))


def _flight(s, d):
    e = events(s, d).select("t", (F.col("t") + F.floor(F.coalesce("value", F.lit(0.0)) * 60_000)).cast("bigint").alias("done"))
    return S.in_flight(e, "t", "done")


def _cooldown(s, d):
    e = events(s, d).withColumn("wait", F.when(F.col("event_type") == "error", F.floor(F.coalesce("value", F.lit(0.0)) * 60_000).cast("bigint")))
    return e.select("event_id", S.cooldown_until(F.col("t"), F.col("wait"), ["user_id"]).alias("until"))


def _lru(s, d):
    return S.lru_cache_run(events(s, d), "event_type", "user_id", "value", 12_000)


def _admission(s, d):
    make = lambda: S.Admission(client=(2, DAY), everyone=(200, DAY), per_day=(150, DAY), client_day=(2, DAY))
    return S.admission(events(s, d), "user_id", make)


def _latest(s, d):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("t"), F.desc("event_id"))
    return events(s, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", "event_id")


def _props(s, d):
    return table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), S.retry_after_seconds(F.coalesce("value", F.lit(0.0)) * 100).alias("seconds"))


def _hourly(s, d):
    e = events(s, d)
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    "state_token_bucket": _bucket,
    "state_window_counter": _window,
    "state_ttl_cache": _ttl,
    "state_in_flight": _flight,
    "state_cooldown": _cooldown,
    "state_lru_cache": _lru,
    "state_admission": _admission,
    "state_latest": _latest,
    "events_props": _props,
    "events_hourly": _hourly,
}

_E = "e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS k FROM (SELECT DISTINCT ON (event_id) * FROM events))"
_RATE = f"(2.0::DOUBLE / {DAY})"
_ALL_RATE = f"(200.0::DOUBLE / {DAY})"
_PAIR = "STRUCT(n DOUBLE, t BIGINT)"
# one row for each event in order; the buckets and days of all clients are two maps that go from row to row
_ADMIT = f"""e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS k, (epoch_us(ts) // 1000) AS t, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM (SELECT DISTINCT ON (event_id) * FROM events)),
b AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS event_id, MAP {{}}::MAP(VARCHAR, {_PAIR}) AS bk, NULL::{_PAIR} AS sh, NULL::{_PAIR} AS dy, MAP {{}}::MAP(VARCHAR, {_PAIR}) AS cd, NULL::VARCHAR AS outcome, 0::BIGINT AS wait UNION ALL
  SELECT e.i, e.event_id,
    CASE WHEN e.k IS NULL THEN bk ELSE map_concat(bk, MAP {{e.k: {{'n': CASE WHEN NOT ok1 THEN t1 WHEN ok2 AND ok3 AND ok4 THEN t1 - 1 ELSE least(2.0, t1 - 1 + 1) END, 't': e.t}}::{_PAIR}}}) END,
    CASE WHEN NOT ok1 THEN sh ELSE {{'n': CASE WHEN NOT ok2 THEN t2 WHEN ok3 AND ok4 THEN t2 - 1 ELSE least(200.0, t2 - 1 + 1) END, 't': e.t}}::{_PAIR} END,
    CASE WHEN NOT (ok1 AND ok2) THEN dy ELSE {{'n': CASE WHEN ok3 AND ok4 THEN d3 + 1 ELSE d3 END, 't': a3}}::{_PAIR} END,
    CASE WHEN e.k IS NULL OR NOT (ok1 AND ok2 AND ok3) THEN cd ELSE map_concat(cd, MAP {{e.k: {{'n': CASE WHEN ok4 THEN d4 + 1 ELSE d4 END, 't': a4}}::{_PAIR}}}) END,
    CASE WHEN NOT ok1 THEN 'rate_limited' WHEN NOT ok2 THEN 'busy' WHEN NOT ok3 THEN 'daily_limit' WHEN NOT ok4 THEN 'client_daily_limit' ELSE 'admitted' END,
    CASE WHEN NOT ok1 THEN CAST(ceil((1 - t1) / {_RATE}) AS BIGINT) WHEN NOT ok2 THEN CAST(ceil((1 - t2) / {_ALL_RATE}) AS BIGINT) WHEN NOT ok3 THEN a3 + {DAY} - e.t WHEN NOT ok4 THEN a4 + {DAY} - e.t ELSE 0 END
  FROM b JOIN e ON e.i = b.i + 1, LATERAL (SELECT bk[e.k] AS p1, cd[e.k] AS p4) p,
    LATERAL (SELECT CASE WHEN e.k IS NULL THEN 2.0 WHEN p1 IS NULL THEN 2.0 ELSE least(2.0::DOUBLE, p1.n + (e.t - p1.t) * {_RATE}) END AS t1, CASE WHEN sh IS NULL THEN 200.0 ELSE least(200.0::DOUBLE, sh.n + (e.t - sh.t) * {_ALL_RATE}) END AS t2,
      CASE WHEN dy IS NULL OR e.t - dy.t >= {DAY} THEN 0 ELSE dy.n END AS d3, CASE WHEN dy IS NULL OR e.t - dy.t >= {DAY} THEN e.t ELSE dy.t END AS a3, CASE WHEN p4 IS NULL OR e.t - p4.t >= {DAY} THEN 0 ELSE p4.n END AS d4, CASE WHEN p4 IS NULL OR e.t - p4.t >= {DAY} THEN e.t ELSE p4.t END AS a4) v,
    LATERAL (SELECT t1 >= 1 AS ok1, t2 >= 1 AS ok2, d3 < 150 AS ok3, e.k IS NULL OR d4 < 2 AS ok4) o)"""
SQL = {
    "state_token_bucket": f"""WITH RECURSIVE {_E}, b AS (SELECT event_id, user_id, k, t, 2.0::DOUBLE AS had FROM e WHERE k = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.k, e.t, least(2.0::DOUBLE, CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END + (e.t - b.t) * {_RATE}) FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.k = b.k + 1)
SELECT event_id, had >= 1 AS admitted, CASE WHEN had >= 1 THEN 0 ELSE CAST(ceil((1 - had) / {_RATE}) AS BIGINT) END AS wait_ms FROM b""",
    "state_window_counter": f"""WITH RECURSIVE {_E}, b AS (SELECT event_id, user_id, k, t, t AS opened, 0 AS used FROM e WHERE k = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.k, e.t, CASE WHEN e.t - b.opened >= {2 * DAY} THEN e.t ELSE b.opened END, CASE WHEN e.t - b.opened >= {2 * DAY} THEN 0 ELSE least(3, b.used + 1) END FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.k = b.k + 1)
SELECT event_id, used < 3 AS admitted, CASE WHEN used < 3 THEN 0 ELSE opened + {2 * DAY} - t END AS wait_ms FROM b""",
    "state_ttl_cache": f"""WITH RECURSIVE {_E}, b AS (SELECT event_id, user_id, k, t AS stored, false AS hit FROM e WHERE k = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t - b.stored < {DAY} THEN b.stored ELSE e.t END, e.t - b.stored < {DAY} FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.k = b.k + 1) SELECT event_id, hit FROM b""",
    "state_in_flight": """WITH e AS (SELECT (epoch_us(ts) // 1000) AS t, (epoch_us(ts) // 1000) + CAST(floor(coalesce(value, 0) * 60000) AS BIGINT) AS d FROM (SELECT DISTINCT ON (event_id) * FROM events)), k AS (SELECT t, 1 AS n FROM e UNION ALL SELECT d, -1 FROM e), p AS (SELECT t, sum(n) AS n FROM k GROUP BY t)
SELECT t, CAST(sum(n) OVER (ORDER BY t) AS BIGINT) AS open FROM p""",
    "state_cooldown": """WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, CASE WHEN event_type = 'error' THEN CAST(floor(coalesce(value, 0) * 60000) AS BIGINT) END AS w FROM (SELECT DISTINCT ON (event_id) * FROM events))
SELECT event_id, max(CASE WHEN w > 0 THEN t + w END) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS until FROM e""",
    "state_admission": f"WITH RECURSIVE {_ADMIT} SELECT event_id, outcome, wait AS wait_ms FROM b WHERE i > 0",
    "state_lru_cache": """WITH RECURSIVE e AS (SELECT event_type AS p, coalesce(CAST(user_id AS VARCHAR), '-') AS k, CAST(trunc(coalesce(value, 0)) AS BIGINT) + 64 AS n, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM (SELECT DISTINCT ON (event_id) * FROM events)),
b AS (SELECT p, 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS ks, CAST([] AS BIGINT[]) AS cs, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS evictions FROM (SELECT DISTINCT p FROM e) UNION ALL
  SELECT b.p, e.i, CASE WHEN spot > 0 THEN list_append(list_concat(ks[1:spot - 1], ks[spot + 1:]), e.k) ELSE (list_append(ks, e.k))[gone + 1:] END, CASE WHEN spot > 0 THEN list_append(list_concat(cs[1:spot - 1], cs[spot + 1:]), cs[spot]) ELSE (list_append(cs, e.n))[gone + 1:] END,
    hits + CASE WHEN spot > 0 THEN 1 ELSE 0 END, misses + CASE WHEN spot > 0 THEN 0 ELSE 1 END, evictions + gone
  FROM b JOIN e ON e.p IS NOT DISTINCT FROM b.p AND e.i = b.i + 1, LATERAL (SELECT coalesce(list_position(ks, e.k), 0) AS spot) x,
    LATERAL (SELECT CASE WHEN spot > 0 THEN 0 ELSE list_filter(range(0, len(ks) + 1), lambda z_: z_ = len(ks) OR list_sum((list_append(cs, e.n))[z_ + 1:]) <= 12000)[1] END AS gone) y)
SELECT p, hits, misses, evictions, CAST(list_sum(cs) AS BIGINT) AS held FROM b WHERE i = (SELECT max(i) FROM e WHERE e.p IS NOT DISTINCT FROM b.p)""",
    "state_latest": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS r FROM (SELECT DISTINCT ON (event_id) * FROM events)) WHERE r = 1",
    "events_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, greatest(1, CAST(ceil(coalesce(value, 0) * 100 / 1000) AS BIGINT)) AS seconds FROM events",
    "events_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY ALL",
}
