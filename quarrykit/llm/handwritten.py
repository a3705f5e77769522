"""Problem 2: files that were not written by hand in their repository.

Token streams are winnowed to fingerprints; a file most of whose fingerprints stand in the
files of several unrelated owners is a vendored copy, whatever its path and banner say.  Evidence
inside the single file (leading comment, layout, make-up of the tokens) finds generated, compiled,
minified and data files, which have no copies.  A file that neither finds is judged by its path and
banner.

Defined results: null or empty content and null paths are hand-written; a file shorter than
one run of tokens has no fingerprint; repeated rows give one row.  Repositories of one owner
(the part of the name before "/") are related; a null repo is an owner of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.origin import claims, evidence, fingerprints, tokens
from quarrykit.session import checkpointed, spread

CODE_PATH = r"(?i)\.(?:js|mjs|cjs|jsx|ts|tsx)$"
OWNERS = 3  # fewest unrelated owners in whose files a recurring fingerprint stands
# A recurring fingerprint comes from the one file of least hash that holds it.  Those of a library come from one
# file, whatever was edited in the copy; imports and boilerplate that files have in common come from many.
FEWEST, SHARE = 16, 0.5  # least share of a file's fingerprints that recur and come from one file, if it has so many
FEWEST_SHORT, SHARE_SHORT = 6, 0.75  # the same for shorter files
FEWEST_TOKENS = 40  # a file of still fewer fingerprints is a copy if its whole token stream, so long at least, recurs

HOT = 1_000_000  # a recurring fingerprint in so many files is joined by broadcast: there is at most one for each million of all prints

FEATURES = "file_id BIGINT, repo STRING, path STRING, reasons ARRAY<STRING>, claims ARRAY<STRING>, prints ARRAY<BIGINT>, stream BIGINT"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        reasons, claimed, prints, streams = [], [], [], []
        for path, text in zip(b.path, b.content):
            toks = tokens(text) if text else []
            reasons.append(evidence(path, text, toks) if toks else [])
            claimed.append(claims(path, text) if toks else [])
            prints.append(fingerprints(toks))
            short = len(prints[-1]) < FEWEST and len(toks) >= FEWEST_TOKENS
            streams.append(xxhash.xxh64_intdigest("\0".join(toks).encode("utf-8", "surrogatepass")) - (1 << 63) if short else None)
        yield pd.DataFrame({"file_id": b.file_id, "repo": b.repo, "path": b.path, "reasons": reasons, "claims": claimed, "prints": prints, "stream": pd.array(streams, "Int64")})


def features(files: DataFrame) -> DataFrame:
    src = files.select("file_id", "repo", "path", "content").where(F.col("path").rlike(CODE_PATH))
    return spread(src).mapInPandas(_features, FEATURES)


def classified(files: DataFrame) -> DataFrame:
    """One row per code file: its reasons, the share of recurring fingerprints, and whether it is hand-written.

    The owners of a fingerprint are counted before anything is joined: (fingerprint, owner) is
    made distinct with map-side combining, so a fingerprint in a third of all files is one
    row for each owner.  Only recurring fingerprints go on into the join, and those in very many
    files meet them without a shuffle.
    """
    f = checkpointed(features(files))
    owner = F.xxhash64(F.coalesce(F.split_part("repo", F.lit("/"), F.lit(1)), F.lit("")))
    prints = f.select("file_id", owner.alias("owner"), F.explode("prints").alias("print"))
    recurring = (
        prints.groupBy("print", "owner").agg(F.min(F.xxhash64("file_id")).alias("source"), F.count("*").alias("n"))
        .groupBy("print").agg(F.count("*").alias("owners"), F.min("source").alias("source"), F.sum("n").alias("n"))
        .where(F.col("owners") >= OWNERS).select("print", "source", (F.col("n") >= HOT).alias("hot"))
    )
    recurring = checkpointed(recurring)
    own = prints.select("file_id", "print")
    hot = F.broadcast(recurring.where("hot").drop("hot"))
    met = own.join(hot, "print", "left_anti").join(recurring.where("not hot").drop("hot"), "print").unionByName(own.join(hot, "print"))
    # repeated rows of a file are one: its fingerprints are distinct in a row, so they are counted for each of its rows alike
    rows = f.groupBy("file_id").agg(
        *[F.first(c).alias(c) for c in ("repo", "path")], F.first("reasons").alias("reasons"), F.first("claims").alias("claims"),
        F.first(F.size("prints")).alias("prints"), F.first("stream").alias("stream"), F.count("*").alias("copies"),
    )
    shared = (
        met.groupBy("file_id", "source").agg(F.count("*").alias("n"))
        .groupBy("file_id").agg(F.sum("n").alias("shared"), F.max("n").alias("same"))
    )
    streams = f.select("stream", owner.alias("owner")).where("stream IS NOT NULL").distinct().groupBy("stream").agg(F.count("*").alias("stream_owners"))
    n = F.col("prints")
    part = lambda c: F.coalesce(c, F.lit(0)) / F.col("copies") / F.greatest("prints", F.lit(1))
    copied = ((n >= FEWEST) & (part("same") >= SHARE)) | ((n >= FEWEST_SHORT) & (part("same") >= SHARE_SHORT)) | (F.coalesce("stream_owners", F.lit(0)) >= OWNERS)
    reasons = F.when(copied, F.array_append("reasons", F.lit("vendored-copy"))).when(F.size("reasons") == 0, F.col("claims")).otherwise(F.col("reasons"))
    return (
        rows.join(shared, "file_id", "left")
        .join(streams.where(F.col("stream_owners") >= OWNERS), "stream", "left")
        .withColumn("shared_share", F.round(part("shared"), 6))
        .withColumn("reasons", reasons)
        .select("file_id", "repo", "path", "reasons", "claims", "prints", "shared_share", (F.size("reasons") == 0).alias("handwritten"))
    )


def not_handwritten(files: DataFrame) -> DataFrame:
    return classified(files).where(~F.col("handwritten")).select("file_id")


def composition(files: DataFrame) -> DataFrame:
    """Code files and those not hand-written, for each repository."""
    c = classified(files)
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return c.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.count_if("handwritten").alias("handwritten"),
        has("vendored-copy").alias("vendored_copies"),
        has("generated-header").alias("generated"),
        has("minified").alias("minified"),
        has("data").alias("data_files"),
    )
