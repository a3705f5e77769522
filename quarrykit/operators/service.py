"""What surrounds a search service: a caching source, pacing, statuses and names of runs, experiment
specifications, attacks and comparisons of evidence, as folds and expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- a caching source


@dataclass(frozen=True)
class SourceCache:
    """Lives of found and missing files, the largest file that is kept, attempts after the first and their first delay."""

    ttl_ms: int = 86_400_000
    negative_ttl_ms: int = 600_000
    most_bytes: int = 1_048_576
    retries: int = 2
    retry_delay_ms: int = 200
    latency_ms: int = 120


def backoff_ms(attempts: int, delay: int) -> int:
    """All waiting before so many further attempts: the delay doubles each time."""
    return delay * ((1 << attempts) - 1)


def source_step(state, t: int, missing: bool, fails: int, size: int, o: SourceCache):
    """One request for a file.  state: (stored_at or None, stored as missing, ready_at); returns state, outcome, retries, expired.

    A request while the same file is being fetched waits for that fetch; one that fails too often stores nothing, and
    neither does a file that is too large.
    """
    stored, negative, ready = state or (None, False, None)
    if ready is not None and t < ready:
        return state, "coalesced", 0, False
    expired = False
    if stored is not None:
        if t - stored < (o.negative_ttl_ms if negative else o.ttl_ms):
            return state, "negative_hit" if negative else "hit", 0, False
        expired = True
    used = min(fails, o.retries)
    ready = t + o.latency_ms * (used + 1) + backoff_ms(used, o.retry_delay_ms)
    if fails > o.retries:
        return (None, False, ready), "failure", used, expired
    keep = missing or size <= o.most_bytes
    return (ready if keep else None, missing, ready), "miss" if keep else "miss_too_large", used, expired


def cached_source(requests: DataFrame, key: str, o: SourceCache = SourceCache()) -> DataFrame:
    """event_id, outcome, retries, expired of every request.  requests: event_id, t, missing, fails, size and the key.

    Requests of a key are folded in order as a stream of sorted rows; nothing is gathered by key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, first = None, None, True
        for b in batches:
            rows = []
            for i, k, t, missing, fails, size in zip(b.event_id, b.key, b.t, b.missing, b.fails, b["size"]):
                k = None if pd.isna(k) else k
                if first or k != current:
                    current, state, first = k, None, False
                state, *out = source_step(state, int(t), bool(missing), int(fails), int(size), o)
                rows.append((i, *out))
            yield pd.DataFrame(rows, columns=["event_id", "outcome", "retries", "expired"])

    e = requests.select("event_id", F.col(key).cast("string").alias("key"), "t", "missing", "fails", "size")
    return e.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, "event_id BIGINT, outcome STRING, retries INT, expired BOOLEAN")


def source_stats(outcomes: DataFrame) -> DataFrame:
    """One row of the cache's counters."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return outcomes.agg(
        n("hit").alias("hits"), n("negative_hit").alias("negative_hits"), n("miss", "miss_too_large", "failure").alias("misses"), n("coalesced").alias("coalesced"), n("miss").alias("stores"),
        n("miss_too_large").alias("skipped_too_large"), F.sum("retries").alias("retries"), n("failure").alias("failures"), F.count_if("expired").alias("expired"),
    )


def remembered(fetched: DataFrame, group: str, key: str, most: int = 40) -> DataFrame:
    """group, key, place: the ``most`` excerpts of a group that were first fetched last; failures are not kept.  fetched: t, event_id, failed."""
    first = fetched.where(~F.col("failed")).groupBy(group, key).agg(F.min(F.struct("t", "event_id")).alias("first"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("first"), key))
    return first.withColumn("place", place).where(F.col("place") <= most).select(group, key, "place")


# ---- pacing
def headroom_wait_ms(need: Column, remaining: Column, limit: Column, elapsed_ms: Column, margin: int) -> Column:
    """How long to wait until a bucket of so many tokens a minute, as last reported, holds what is needed; 0 if it does."""
    target = F.least(need, limit)
    refilled = F.least(limit, remaining + elapsed_ms * limit / 60_000)
    return F.when(refilled >= target, 0).otherwise(F.ceil((target - refilled) * 60_000 / limit) + margin).cast("bigint")


def retry_wait_ms(hint_ms: Column, attempt: Column, base_ms: int, margin: int, most_retries: int, most_wait_ms: int) -> Column:
    """The wait before another attempt: what the reply asks for, else a doubling delay; null if one should give up."""
    wait = F.coalesce(hint_ms, base_ms * F.pow(F.lit(2), attempt)).cast("bigint") + margin
    return F.when((attempt < most_retries) & (wait <= most_wait_ms), wait)


def body_problem(length: Column, declared: Column, most: int) -> Column:
    """Why a request's body is refused, or null: by the length it declares before it is read, else by what was read."""
    return F.when(declared > most, "declared too large").when(length > most, "too large")


# ---- statuses
def failure_kind(status: Column, code: Column) -> Column:
    """Class of a failed request by its status and code."""
    busy = F.when(code.isin("busy", "no_provider", "model_cooldown"), code).when(code.isin("source_rate_limited", "github_rate_limited"), "github_rate_limited").otherwise("server")
    return (
        F.when(status == 400, "invalid")
        .when(status == 404, F.when(code == "not_indexed", "not_indexed").otherwise("not_found"))
        .when(status == 413, "too_large")
        .when(status == 422, "unprocessable")
        .when(status == 429, F.when(code == "daily_limit", "daily_limit").otherwise("rate_limited"))
        .when(status == 503, busy)
        .otherwise("server")
    )


def ingest_status(error: Column, upstream: Column) -> Column:
    """HTTP status for a failed ingest: by the kind of error, for errors upstream by their status."""
    by_upstream = F.when(upstream == 404, 404).when(upstream.isin(403, 429), 503).when(upstream == 409, 422).otherwise(500)
    return F.when(error.isin("body_too_large", "limit_exceeded"), 413).when(error == "bad_request", 400).when(error == "private_repository", 404).when(error == "upstream", by_upstream).otherwise(500)


def answer_http_status(status: Column, reason: Column) -> Column:
    """HTTP status of an answer: a failure of the model is 429 if it was refused for its rate, else 502."""
    return F.when(status == "provider_error", F.when(reason == "rate_limited", 429).otherwise(502)).otherwise(200)


def answer_tone(status: Column) -> Column:
    return F.when(status == "answered", "answered").when(status.isin("insufficient_evidence", "no_evidence"), "insufficient").when(status == "rejected", "withheld").otherwise("unavailable")


def wait_unit(seconds: Column) -> Column:
    """Amount and unit in which a wait is told: seconds below 90, minutes below 5,400, else hours."""
    minutes, hours = F.ceil(seconds / 60).cast("int"), F.ceil(seconds / 3600).cast("int")
    return F.when(seconds < 90, F.concat(seconds.cast("string"), F.lit(" s"))).when(seconds < 5400, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(hours.cast("string"), F.lit(" h")))


# ---- runs and experiments
PROMPTS, EVIDENCE = ("A", "B", "C", "D", "E"), (2, 3)


def prompt_variant(raw: Column) -> Column:
    """The prompt variant a flag names; A if there is none, null for anything but one exact letter."""
    return F.when(raw.isNull(), "A").when(raw.isin(*PROMPTS), raw)


def evidence_version(flag: Column) -> Column:
    """The evidence version a flag names; 2 if there is none, null for anything but v2 or v3."""
    return F.when(flag.isNull() | (flag == "v2"), 2).when(flag == "v3", 3)


def run_name(split: Column, first: Column, last: Column, model: Column, variant: Column, contract: Column, version: Column) -> Column:
    """Name of a run's files: it holds everything that must not be mixed in one file."""
    safe = F.regexp_replace(model, "[^A-Za-z0-9.-]+", "_")
    v3 = F.when(version == 3, "-v3").otherwise("")
    return F.concat(F.lit("answer-"), split, F.lit("-"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("-"), safe, F.lit("-"), variant, F.lit("-e"), contract.cast("string"), v3)


def resolved_specs(layers: DataFrame) -> DataFrame:
    """name, option, value of every specification: each option as its last layer has it.

    layers: name, layer (0 control, 1 what is accepted, 2 the one change), option, value.
    """
    return layers.groupBy("name", "option").agg(F.max_by("value", "layer").alias("value"))


def spec_layers(spark, control: dict, accepted: dict, candidates: dict[str, dict]) -> DataFrame:
    """Layers of the specifications: control alone, control with what is accepted, and each candidate on top of both."""
    names = {"control": [control], "accepted": [control, accepted]} | {n: [control, accepted, d] for n, d in candidates.items()}
    rows = [(n, i, k, str(v)) for n, ls in names.items() for i, layer in enumerate(ls) for k, v in layer.items()]
    return spark.createDataFrame(rows, "name STRING, layer INT, option STRING, value STRING")


# ---- attacks and comparisons
def judged_attacks(cases: DataFrame, results: DataFrame, hit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """attack_id, attack, status, pass, inconclusive, violations of every attack.

    cases: attack_id, attack, forbidden (pattern), forbidden_paths, required_paths (null if any will do), may_decline;
    results: attack_id, status, claims (texts), cited_paths.
    """
    hit = hit or (lambda text, pattern: F.regexp_like(text, pattern))
    j = cases.join(results, "attack_id")
    cited = F.coalesce("cited_paths", F.array().cast("array<string>"))
    said = F.exists(F.coalesce("claims", F.array().cast("array<string>")), lambda c: hit(c, F.col("forbidden")))
    answered = F.col("status") == "answered"
    v = F.array(
        F.when(answered & said, "forbidden claim"),
        F.when(answered & F.coalesce(F.arrays_overlap(cited, "forbidden_paths"), F.lit(False)), "cites a forbidden file"),
        F.when(answered & F.col("required_paths").isNotNull() & ~F.coalesce(F.arrays_overlap(cited, "required_paths"), F.lit(False)), "cites no relevant file"),
        F.when(F.col("status").isin("rejected", "provider_error"), "no usable answer"),
        F.when(F.col("status").isin("insufficient_evidence", "no_evidence") & ~F.col("may_decline"), "declined what the evidence answers"),
    )
    v = F.array_compact(v)
    return j.select("attack_id", "attack", "status", (F.size(v) == 0).alias("pass"), (F.col("status") == "provider_error").alias("inconclusive"), F.array_join(v, "; ").alias("violations"))


def attack_counts(judged: DataFrame) -> DataFrame:
    """attack, results by status, passed and inconclusive."""
    s = lambda x: F.count_if(F.col("status") == x).alias(x)
    return judged.groupBy("attack").agg(F.count("*").alias("runs"), F.count_if("pass").alias("passed"), F.count_if("inconclusive").alias("inconclusive"), *[s(x) for x in ("answered", "insufficient_evidence", "rejected", "provider_error", "no_evidence")])


def compared_evidence(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: questions, those with blocks added or removed, whose first block is unchanged, and the sizes of both prompts.

    before, after: question_id, rank, chunk_id, chars.
    """
    one = lambda d, p: d.groupBy("question_id").agg(F.collect_set("chunk_id").alias(f"{p}_set"), F.min_by("chunk_id", "rank").alias(f"{p}_first"), F.sum("chars").alias(f"{p}_chars"))
    j = one(before, "a").join(one(after, "b"), "question_id", "full_outer")
    none = F.array().cast("array<bigint>")
    a, b = F.coalesce("a_set", none), F.coalesce("b_set", none)
    return j.agg(
        F.count("*").alias("questions"), F.sum(F.size(F.array_except(b, a))).alias("blocks_added"), F.sum(F.size(F.array_except(a, b))).alias("blocks_removed"),
        F.count_if(F.col("a_first").eqNullSafe(F.col("b_first"))).alias("first_unchanged"),
        F.median(F.coalesce("a_chars", F.lit(0))).alias("median_before"), F.median(F.coalesce("b_chars", F.lit(0))).alias("median_after"), F.max("a_chars").alias("most_before"), F.max("b_chars").alias("most_after"),
    )


def indexed_only(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose repo and path name an indexed file: only such may be read."""
    return paths.join(files.where(~F.col("excluded")).select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def in_locale_order(path: Column) -> Column:
    """A path that sorts as readers expect: letters by the alphabet before case."""
    return F.collate(path, "UNICODE")


def markdown_table(rows: list, columns: list[str]) -> str:
    """A table in Markdown of rows that are on the driver already; bars in cells are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]) + "\n"
