"""Problem 7: passages of held-out evaluation texts that stand in documents.

Word n-grams of the passages are the seeds; documents that share enough of them with a
passage are aligned with it by Smith-Waterman in windows around the hits.  How many are
enough follows from what a leak is (half of the words, an interruption, one word in eight
changed), so the count loses none; of the seeds of a passage only so many of its commonest
may be left out as the count can spare.

Defined results: null or empty documents and passages are in no pair; repeated rows count once; a
document may hold several passages and a passage may stand in any number of documents;
passages of the same words are searched for once and all reported; a passage of fewer words
than a seed is looked for as one seed of all its words; a stretch of fewer words than a seed
counts for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.alignment import coverage, gram_array, gram_hashes, words
from quarrykit.session import checkpointed, spread

SEED = 3  # words of a seed
RARE = 3  # a seed of at most so many passages is never left out
HITS = 2  # seeds of one passage, besides those left out, that a document must hold
LEAST = 0.5  # least share of the passage's words that stand in the document
PURE = 0.75  # least share of matching words in the aligned stretches
SLACK = 10  # words beside a diagonal of hits that are aligned
BROADCAST_ROWS = 500_000  # seeds are broadcast up to this many rows (24 bytes each), joined by shuffle beyond


def least_seeds(length: int) -> int:
    """Seeds of a passage of so many words that every leak of it shares, if each changed word and each end spoils all it can."""
    if length <= SEED:
        return 1
    held = -(-length // 2)
    return max(1, held - 2 * (SEED - 1) - SEED * (held // 7))


def _passage_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ws = [words(t) for t in b.text]
        yield pd.DataFrame(
            {
                "item_id": b.item_id,
                "class_id": [gram_hashes(w, len(w))[0] if w else None for w in ws],
                "item_words": ws,
                "seeds": [gram_hashes(w, min(SEED, len(w))) if w else [] for w in ws],
                "least": [least_seeds(len(w)) for w in ws],
            }
        ).astype({"class_id": "Int64"})


def _document_batches(lengths: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [words(t) for t in b.text]
            for n in lengths:
                yield pd.DataFrame({"doc_id": b.doc_id, "grams": [gram_array(w, n) for w in ws]})

    return run


def _word_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b.doc_id, "doc_words": [words(t) for t in b.text]})


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for d, c, dw, lo, iw, hits in zip(b.doc_id, b.class_id, b.doc_words, b.lo, b.item_words, b.hits):
            matched, spanned = coverage(list(iw), list(dw), [(h["doc_pos"] - lo, h["item_pos"]) for h in hits], PURE)
            rows.append((d, c, len(iw), matched, spanned))
        yield pd.DataFrame(rows, columns=["doc_id", "class_id", "item_length", "matched", "spanned"])


def seeds_of(classes: DataFrame) -> DataFrame:
    """class_id, item_pos, gram, needed: the seeds looked for and how many of them a document must hold.

    The seeds of a passage are ranked by the passages they stand in.  Of those in more than ``RARE``
    the commonest are left out, at most least - HITS of them, and every one left out lowers what is needed by one.
    """
    at = classes.select("class_id", "least", F.posexplode("seeds").alias("item_pos", "gram"))
    among = at.groupBy("gram").agg(F.countDistinct("class_id").alias("among"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("among"), "gram", "item_pos"))
    own = at.join(among, "gram").withColumn("out", (rank <= F.greatest(F.col("least") - HITS, F.lit(0))) & (F.col("among") > RARE))
    lost = F.sum(F.col("out").cast("int")).over(Window.partitionBy("class_id"))
    return own.withColumn("needed", F.col("least") - lost).where(~F.col("out")).select("class_id", "item_pos", "gram", "needed")


def alignments(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Candidate pairs with the matched and spanned words of the passage, whole or in two stretches."""
    p = passages.select("item_id", "text").where("text <> ''").dropDuplicates(["item_id"]).mapInPandas(
        _passage_batches, "item_id BIGINT, class_id BIGINT, item_words ARRAY<STRING>, seeds ARRAY<BIGINT>, least INT"
    )
    p = checkpointed(p.where("class_id IS NOT NULL"))
    classes = p.groupBy("class_id").agg(F.first("item_words").alias("item_words"), F.first("seeds").alias("seeds"), F.first("least").alias("least"))
    seeds = checkpointed(seeds_of(classes))
    # a seed is as long as its passage or SEED words, so there are SEED lengths at most
    lengths = sorted(r.n for r in classes.select(F.least(F.size("item_words"), F.lit(SEED)).alias("n")).distinct().collect())
    source = documents.select("doc_id", "text").where("text <> ''")
    d = spread(source).mapInPandas(_document_batches(lengths), "doc_id BIGINT, grams ARRAY<BIGINT>")
    grams = d.select("doc_id", F.posexplode("grams").alias("doc_pos", "gram"))
    if seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    hits = checkpointed(
        grams.join(seeds, "gram")
        .groupBy("doc_id", "class_id")
        .agg(F.collect_set(F.struct("doc_pos", "item_pos")).alias("hits"), F.countDistinct("item_pos").alias("seeds"), F.first("needed").alias("needed"))
        .where(F.col("seeds") >= F.col("needed"))
        .drop("seeds", "needed")
    )
    # only candidate documents are split into words again, and a pair takes the words around its hits alone
    own = spread(source.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    texts = own.mapInPandas(_word_batches, "doc_id BIGINT, doc_words ARRAY<STRING>").dropDuplicates(["doc_id"])
    at = F.transform("hits", lambda h: h["doc_pos"] - h["item_pos"])
    lo = F.greatest(F.array_min(at) - SLACK, F.lit(0))
    pairs = (
        hits.join(texts, "doc_id").join(classes.select("class_id", "item_words"), "class_id")
        .withColumn("lo", lo)
        .withColumn("doc_words", F.slice("doc_words", F.col("lo") + 1, F.array_max(at) + F.size("item_words") + SLACK - F.col("lo")))
    )
    found = pairs.select("doc_id", "class_id", "doc_words", "lo", "item_words", "hits").mapInPandas(
        _align, "doc_id BIGINT, class_id BIGINT, item_length INT, matched INT, spanned INT"
    )
    return found.join(p.select("class_id", "item_id"), "class_id").drop("class_id")


def leaks(documents: DataFrame, passages: DataFrame) -> DataFrame:
    a = alignments(documents, passages)
    return a.where((F.col("matched") >= LEAST * F.col("item_length")) & (F.col("matched") >= PURE * F.col("spanned")))


def found(documents: DataFrame, passages: DataFrame) -> DataFrame:
    return leaks(documents, passages).select("doc_id", "item_id")


def leaked_items(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Every passage with the number of documents that hold it and the fullest match."""
    got = leaks(documents, passages).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.round(F.max(F.col("matched") / F.col("item_length")), 6).alias("best_match")
    )
    return passages.select("item_id", "repo", "kind").dropDuplicates(["item_id"]).join(got, "item_id", "left").fillna(0, ["documents"])
