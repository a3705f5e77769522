"""Scores of whole blocks against brute force: more than one block, caps for each file and equal scores."""

import collections
import math
import random

from pyspark.sql import functions as F

from quarrykit.operators import index as I
from quarrykit.operators import retrieval as R
from quarrykit.operators import scoring as X
from test_operators import corpus, files  # noqa: F401


def blocks(spark):
    rng = random.Random(3)
    words = ["token", "store", "parseConfig", "TokenStore", "load_tokens", "queries", "classes", "status", "x1y2", "HTTPServer", "$el", "the", "return", "is", "A", "café"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts[40:50] = [texts[3]] * 10
    rows = [("o/r" if i < 50 else "o/s", i, i // 5, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "repo STRING, chunk_id BIGINT, file_id BIGINT, text STRING")


def test_packed_terms_are_those_of_the_expressions(spark, rows):
    b = blocks(spark)
    want = rows(I.term_frequencies(b, ["repo", "chunk_id"]), "repo", "chunk_id", "term", "tf")
    p = I.packed(b)
    assert rows(I.postings(p), "repo", "chunk_id", "term", "tf") == want and want
    again = I.packed_postings(I.postings(p), b.select("repo", "chunk_id", "file_id"))
    assert rows(again, "chunk_id", "term_count", "terms", "tfs") == rows(p, "chunk_id", "term_count", "terms", "tfs")


def test_blocks_hold_the_best_of_a_repository(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 7)
    p = I.packed(blocks(spark))
    q = spark.createDataFrame([("o/r", 1, ["token", "store", "absent"]), ("o/s", 2, ["query", "token"]), ("o/r", 3, []), ("none", 4, ["token"])], "repo STRING, question_id BIGINT, terms ARRAY<STRING>")
    df = I.document_frequencies(I.postings(p), ["repo"])
    got = X.lexical(p, q, df, I.packed_stats(p), 3, 10, 9).collect()
    have = p.collect()
    for question, repo, terms in ((1, "o/r", ["token", "store"]), (2, "o/s", ["query", "token"])):
        own = [r for r in have if r.repo == repo]
        mean = sum(r.term_count for r in own) / len(own)
        tf = {r.chunk_id: dict(zip(r.terms.split(" "), r.tfs)) for r in own}
        score = collections.defaultdict(float)
        for t in terms:
            n = sum(t in x for x in tf.values())
            for r in own:
                if t in tf[r.chunk_id]:
                    f = tf[r.chunk_id][t]
                    score[r.chunk_id] += math.log(1 + (len(own) - n + 0.5) / (n + 0.5)) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * r.term_count / mean))
        order, seen, want = sorted(score, key=lambda c: (-round(score[c], 9), c)), collections.Counter(), []
        for c in order:
            seen[c // 5] += 1
            if seen[c // 5] <= 3:
                want.append(c)
        mine = sorted((r for r in got if r.question_id == question), key=lambda r: (-r.score, r.chunk_id))[:10]
        assert [r.chunk_id for r in mine] == want[:10] and len(mine) > 3
    assert {r.question_id for r in got} == {1, 2}
    assert len(got) < 200


def test_no_row_for_a_pair_of_question_and_chunk(spark):
    """Rows that leave a block are at most ten for each question, however many chunks hold its terms."""
    b = spark.range(5_000).select(F.lit("o/r").alias("repo"), F.col("id").alias("chunk_id"), F.col("id").alias("file_id"), F.lit("token").alias("text"))
    q = spark.range(3).select(F.lit("o/r").alias("repo"), F.col("id").alias("question_id"), F.array(F.lit("token")).alias("terms"))
    p = I.packed(b)
    got = X.lexical(p, q, I.document_frequencies(I.postings(p), ["repo"]), I.packed_stats(p), 3, 10, 9)
    assert sorted(r.chunk_id for r in got.collect()) == sorted(list(range(10)) * 3)


def test_search_is_the_same_over_one_block_and_many(spark, files, rows, monkeypatch):
    q = spark.createDataFrame(
        [("o/r", 1, "Where is `parseConfig` defined?"), ("o/r", 2, "What is the entry point of the token store?"), ("o/r", 3, "load the token config"), ("none", 4, "token")], "repo STRING, question_id BIGINT, question STRING"
    )
    whole = rows(R.search(q, corpus(spark, files)))
    monkeypatch.setattr(X, "BLOCK", 1)
    assert rows(R.search(q, corpus(spark, files))) == whole and len(whole) > 3


def test_texts_are_cut_for_wanted_chunks_alone(spark, rows):
    from quarrykit.plans import common as C

    d = "/root/testdata/sf0.001"
    every = C.chunks(spark, d)
    wanted = every.where("pmod(chunk_id, 3) = 0").select("chunk_id", "file_id")
    got = rows(C.texts(spark, d, wanted.unionByName(wanted)), "chunk_id", "text")
    assert got == rows(every.where("pmod(chunk_id, 3) = 0"), "chunk_id", "text") and got


def test_no_source_is_moved_to_verify_a_chunk(spark, rows, monkeypatch):
    from quarrykit.operators import evidence as E
    from quarrykit.plans import catalogue

    plans, write = [], E.stored
    monkeypatch.setattr(E, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    catalogue.queries()["evidence_verified"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "hashpartitioning(file_id" not in plans[0] and "/ingested_files.parquet" in plans[0]
    src = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")], "file_id BIGINT, content STRING")
    spots = [(10, 1, 1, 2), (11, 1, 2, 3), (12, 1, 3, 4), (13, 2, 1, 1), (14, 3, 1, 1), (15, 1, 0, 1), (16, 1, 1, None)]
    given = spark.createDataFrame(spots * 2, "chunk_id BIGINT, file_id BIGINT, start_line INT, end_line INT").withColumn("chunk_hash", F.substring(F.sha1(F.lit("a\nb")), 1, 12))
    want = rows(E.verified(given, src).select("chunk_id", "reason", "suspect").distinct())
    assert rows(E.verdicts(given, src)) == want and {r[1] for r in want} == {None, "source-mismatch", "range-outside-file", "source-unavailable"}
    for most, scans in ((3, 4), (3, 1)):  # several scans; contents moved
        monkeypatch.setattr(E, "MOST_SPOTS", most)
        monkeypatch.setattr(E, "MOST_SCANS", scans)
        assert rows(E.verdicts(given, src)) == want
