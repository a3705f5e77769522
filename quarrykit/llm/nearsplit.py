"""Problem 3: records of the holdout split that also stand, exactly or almost, in the tuning split.

Edit-distance segment join: the name string of every holdout text is cut into k + 1 segments;
a tuning text within k edits holds one of them unchanged at an allowed position.  Segments and
substrings meet in an equi-join, candidates are verified by banded dynamic programming.
Texts with one canonical form are one class, so copies are joined once.

Defined results: a null or empty text is in no pair; a repo that is null, unknown, without a split or
listed with both belongs to neither side; repeated rows count once; a pair is given once with id_a < id_b.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.wording import FRAME_WORDS, canonical, frame_like, name_string, same, without_slips
from quarrykit.session import checkpointed, spread

EDITS = 4
#: A word is spelt as it is meant if it stands in this many contexts, unless it is a slip of a word so many times as frequent.
COMMON_CONTEXTS, RARER = 5, 50
#: Function words stand in nearly every text: a word one slip from one is meant as it is spelt from this share of all texts on.
REAL_SHARE = 0.0005
MOST_REPOS = 200_000
MOST_SEGMENTS = 1_000_000  # so many segment keys (8 bytes each) are sent to the workers; beyond, they meet by the join alone


def repo_key(c: Column) -> Column:
    """A repository's name after undoing case, outer blanks and a final .git."""
    return F.trim(F.regexp_replace(F.trim(F.lower(c)), r"\.git\s*$", ""))


def edits_for(length: int) -> int:
    return min(EDITS, length // 5)


def cuts(length: int) -> list[tuple[int, int]]:
    """Places of the k + 1 segments of a string: even parts, the longer ones last."""
    n = edits_for(length) + 1
    base, longer = divmod(length, n)
    out, pos = [], 0
    for i in range(n):
        size = base + (i >= n - longer)
        out.append((pos, pos + size))
        pos += size
    return out


@lru_cache(maxsize=100_000)
def _seed(kind: str, length: int, i: int) -> int:
    return xxhash.xxh64_intdigest(f"{kind}|{length}|{i}")


def _key(kind: str, length: int, i: int, part: str) -> int:
    return xxhash.xxh64_intdigest(part, _seed(kind, length, i)) - (1 << 63)


def segment_keys(kind: str, s: str) -> list[int]:
    return [_key(kind, len(s), i, s[a:b]) for i, (a, b) in enumerate(cuts(len(s)))]


@lru_cache(maxsize=10_000)
def _places(n: int) -> list[tuple[int, int, int, int, int]]:
    """(length, segment, its size, first and last place) at which a string of n characters may hold a segment of
    a string of each length within the allowed edits."""
    out = []
    for length in range(max(1, n - EDITS), n + EDITS + 1):
        k, diff = edits_for(length), n - length
        if abs(diff) <= k:
            for i, (a, b) in enumerate(cuts(length)):
                out.append((length, i, b - a, max(0, a - (k - diff) // 2), min(n - (b - a), a + (k + diff) // 2)))
    return out


def substring_keys(kind: str, s: str) -> list[int]:
    """Keys of every substring that may equal a segment of a string within the allowed edits."""
    out = set()
    digest = xxhash.xxh64_intdigest
    for length, i, size, first, last in _places(len(s)):
        seed = _seed(kind, length, i)
        for start in range(first, last + 1):
            out.add(digest(s[start : start + size], seed) - (1 << 63))
    return list(out)


def records(questions: DataFrame, support: DataFrame, repos: DataFrame) -> DataFrame:
    """record_kind, id, repo, split and text of all records of a repository with a split."""
    known = repos.where(F.col("split").isin("tuning", "holdout")).groupBy(repo_key(F.col("repo")).alias("repo"))
    known = known.agg(F.min("split").alias("split"), F.max("split").alias("last")).where(F.col("split") == F.col("last")).drop("last")
    q = questions.select(F.lit("question").alias("record_kind"), F.col("question_id").alias("id"), "repo", F.col("question").alias("text"))
    s = support.select(F.lit("support").alias("record_kind"), F.col("support_id").alias("id"), "repo", F.col("claim").alias("text"))
    r = q.unionByName(s).where(F.col("text").isNotNull()).dropDuplicates(["record_kind", "id"])
    return r.withColumn("repo", repo_key(F.col("repo"))).join(known, "repo")


def short_names(repos: DataFrame) -> frozenset[str]:
    """Short names of all repositories.  The table is a fixed list; a larger one is refused, not cut."""
    rows = repos.select(F.element_at(F.split(repo_key(F.col("repo")), "/"), -1).alias("s")).where("s <> ''").distinct().limit(MOST_REPOS + 1).collect()
    if len(rows) > MOST_REPOS:
        raise ValueError(f"more than {MOST_REPOS} repository names")
    return frozenset(r.s for r in rows)


def canonical_records(r: DataFrame, names: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toks = [canonical(t, names) for t in b.text]
            yield pd.DataFrame(
                {"record_kind": b.record_kind, "id": b.id, "repo": b.repo, "split": b.split, "tokens": toks, "names": [name_string(t) for t in toks]}
            )

    out = spread(r, "record_kind", "id").mapInPandas(run, "record_kind STRING, id BIGINT, repo STRING, split STRING, tokens ARRAY<STRING>, names STRING")
    return out.where(F.size("tokens") > 0).withColumn("class_id", F.xxhash64("record_kind", F.array_join("tokens", " ")))


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = [segment_keys(k, s) for k, s in zip(b.record_kind, b.names)]
        yield pd.DataFrame({"key": keys, "eval_id": b.class_id}).explode("key").dropna().astype({"key": "int64"})


def _substrings(wanted: np.ndarray | None):
    """Substring keys of the training texts; of those given as wanted alone, if they are given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for kind, s, c in zip(b.record_kind, b.names, b.class_id):
                own = np.array(substring_keys(kind, s), np.int64)
                if wanted is not None and len(own):
                    own = own[wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own]
                keys.append(own)
                ids.append(np.full(len(own), c, np.int64))
            yield pd.DataFrame({"key": np.concatenate(keys), "train_id": np.concatenate(ids)})

    return run


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each token of a class with a hash of the tokens around it, slips of frame words left out."""
    for b in batches:
        rows = []
        for kind, toks in zip(b.record_kind, b.tokens):
            kept = [t for t in toks if t != "§" and (t in FRAME_WORDS or not frame_like(t))]
            rows += [(t, _key(kind, 0, 0, " ".join(x for x in kept if x != t))) for t in set(toks)]
        yield pd.DataFrame(rows, columns=["token", "context"])


def _verify(texts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y, c in zip(b.eval_tokens, b.train_tokens, b.common):
                x, y, seen = list(x), list(y), {w["token"]: w["n"] for w in c}
                real = frozenset(t for t, n in seen.items() if n >= REAL_SHARE * texts)
                keep.append(same(x, y, without_slips(x, y, seen, COMMON_CONTEXTS, RARER), real=real))
            yield b.loc[keep, ["eval_id", "train_id"]]

    return run


def class_pairs(classes: DataFrame) -> DataFrame:
    """Verified pairs (eval_id, train_id) of classes with a holdout and a tuning record.

    classes: class_id, record_kind, tokens, names, holdout, tuning (counts).  How common a word is, is
    counted over the different contexts it stands in: copies of one text are one context.
    """
    ev = checkpointed(classes.where("holdout > 0").select("record_kind", "class_id", "names").mapInPandas(_segments, "key BIGINT, eval_id BIGINT"))
    # the segments of the evaluation side filter the substrings where they arise, if they are few; else the join alone does
    few = [r.key for r in ev.select("key").distinct().limit(MOST_SEGMENTS + 1).collect()]
    wanted = np.array(sorted(few), np.int64) if 0 < len(few) <= MOST_SEGMENTS else None
    tr = spread(classes.where("tuning > 0").select("record_kind", "class_id", "names")).mapInPandas(_substrings(wanted), "key BIGINT, train_id BIGINT")
    pairs = ev.join(tr, "key").select("eval_id", "train_id").distinct()
    c = classes.select("class_id", "names", "tokens")
    cand = checkpointed(
        pairs.join(c.select(F.col("class_id").alias("eval_id"), F.col("names").alias("eval_names"), F.col("tokens").alias("eval_tokens")), "eval_id")
        .join(c.select(F.col("class_id").alias("train_id"), F.col("names").alias("train_names"), F.col("tokens").alias("train_tokens")), "train_id")
        .where(F.levenshtein("eval_names", "train_names", EDITS) >= 0)
    )
    exact = cand.where(F.col("eval_id") == F.col("train_id")).select("eval_id", "train_id")
    near = cand.where(F.col("eval_id") != F.col("train_id")).select("eval_id", "train_id", "eval_tokens", "train_tokens")
    seen = spread(classes.select("record_kind", "class_id", "tokens"), "class_id").mapInPandas(_contexts, "token STRING, context BIGINT")
    seen = seen.groupBy("token").agg(F.countDistinct("context").alias("n"))
    common = seen.where(F.col("n") >= COMMON_CONTEXTS)
    differing = near.select(
        "eval_id", "train_id", F.explode(F.array_distinct(F.concat("eval_tokens", "train_tokens"))).alias("token")
    ).join(common, "token").groupBy("eval_id", "train_id").agg(F.collect_list(F.struct("token", "n")).alias("common"))
    checked = near.join(differing, ["eval_id", "train_id"], "left").withColumn("common", F.coalesce("common", F.array().cast("array<struct<token:string,n:bigint>>")))
    return exact.unionByName(checked.mapInPandas(_verify(classes.count()), "eval_id BIGINT, train_id BIGINT"))


def overlaps(questions: DataFrame, support: DataFrame, repos: DataFrame) -> DataFrame:
    """All pairs of records, with both repositories."""
    r, pairs = class_overlaps(questions, support, repos)
    side = lambda split, name: r.where(F.col("split") == split).select(
        F.col("class_id").alias(f"{name}_id"), F.col("id").alias(f"{split}_id"), F.col("repo").alias(f"{split}_repo"), "record_kind"
    )
    joined = pairs.join(side("holdout", "eval"), "eval_id").join(side("tuning", "train").drop("record_kind"), "train_id")
    return joined.select(
        "record_kind",
        F.least("holdout_id", "tuning_id").alias("id_a"),
        F.greatest("holdout_id", "tuning_id").alias("id_b"),
        "holdout_id", "tuning_id", "holdout_repo", "tuning_repo",
    )


def class_overlaps(questions: DataFrame, support: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records with their class, and the pairs of classes that say the same: copies are not multiplied out."""
    r = checkpointed(canonical_records(records(questions, support, repos), short_names(repos)))
    classes = r.groupBy("class_id").agg(
        F.first("record_kind").alias("record_kind"),
        F.first("tokens").alias("tokens"),
        F.first("names").alias("names"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
        F.count_if(F.col("split") == "tuning").alias("tuning"),
    )
    return r, checkpointed(class_pairs(checkpointed(classes)))


def found_pairs(questions: DataFrame, support: DataFrame, repos: DataFrame) -> DataFrame:
    return overlaps(questions, support, repos).select("record_kind", "id_a", "id_b").distinct()


def counts(questions: DataFrame, support: DataFrame, repos: DataFrame) -> DataFrame:
    """For each kind, split and repository: the records that have a counterpart in the other split, and the pairs.

    Counted from the classes and the number of their members, without any pair of records.
    """
    r, pairs = class_overlaps(questions, support, repos)
    members = checkpointed(r.groupBy("class_id", "record_kind", "split", "repo").agg(F.count("*").alias("records")))

    def part(split: str, own: str, other: str) -> DataFrame:
        sizes = members.where(F.col("split") != split).groupBy("class_id").agg(F.sum("records").alias("n"))
        met = pairs.join(sizes.withColumnRenamed("class_id", f"{other}_id"), f"{other}_id").groupBy(F.col(f"{own}_id").alias("class_id")).agg(F.sum("n").alias("partners"))
        mine = members.where(F.col("split") == split).join(met, "class_id")
        return mine.groupBy("record_kind", "split", "repo").agg(F.sum("records").alias("records"), F.sum(F.col("records") * F.col("partners")).alias("pairs"))

    return part("holdout", "eval", "train").unionByName(part("tuning", "train", "eval"))
