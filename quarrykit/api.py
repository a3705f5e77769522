"""The service as functions: build an index, describe a repository, search, answer and read source.

Every function takes a session and a folder of tables and returns DataFrames; many questions are one plan.
``python -m quarrykit`` runs the same from the command line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.config import Policy, SearchOptions
from quarrykit.functions import text as T
from quarrykit.operators import evidence as E
from quarrykit.operators import prompt as PR
from quarrykit.operators import retrieval as R
from quarrykit.operators import validation as W
from quarrykit.plans import common as C
from quarrykit.plans import files as PF
from quarrykit.providers import FolderSource, ModelProvider, SourceProvider, StandIn
from quarrykit.session import checkpointed

TABLES = ("files", "chunks", "postings", "lengths", "frequencies", "stats", "symbols", "declared", "imports", "edges", "entries")


def build_index(spark: SparkSession, folder: str) -> dict[str, int]:
    """Writes all tables of the index (see ``plans.common``) and gives their rows."""
    return {n: C.index_table(spark, folder, n).count() for n in TABLES}


def repo_summary(spark: SparkSession, folder: str, repo: str | None = None) -> DataFrame:
    """One row per repository: its commit, files, chunks and languages; of one repository if it is named."""
    s = PF.QUERIES["repo_summary"](spark, folder)
    return s if repo is None else s.where(F.col("repo") == repo)


def search(spark: SparkSession, folder: str, questions: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """The best chunks of every question with path and lines.  questions: question_id, repo, question."""
    c = C.index_table(spark, folder, "chunks").select("chunk_id", "path", "start_line", "end_line")
    return _ranked(spark, folder, questions, options).withColumnRenamed("path", "path_score").join(c, "chunk_id")


def _ranked(spark: SparkSession, folder: str, questions: DataFrame, options: SearchOptions) -> DataFrame:
    return R.search(questions, C.corpus(spark, folder), options)


def answer(
    spark: SparkSession, folder: str, questions: DataFrame, model: ModelProvider | None = None, source: SourceProvider | None = None, options: SearchOptions = SearchOptions(),
    policy: Policy = Policy(), blocks: int = 8, chars: int = 24_000,
) -> dict[str, DataFrame]:
    """Answers questions: retrieval, late reading of source, admission, prompt, model, citation check.

    Gives the tables answers (question_id, answer_status, reasons, warned), claims, evidence (with the
    reason where a block was not verified), prompts and replies: what the model read and wrote is a
    result like any other.  A question of too little coverage is not asked; a null reply is a failure of the model.
    """
    model, source = model or StandIn(), source or FolderSource(spark, folder)
    c = C.corpus(spark, folder)
    top = checkpointed(_ranked(spark, folder, questions, options))
    decided = R.features(questions, top, c, options).withColumn("decision", R.decision(F.col("idf_coverage"), F.col("evidence"), policy.low, policy.high)).select("question_id", "decision")
    places = C.index_table(spark, folder, "chunks").select("chunk_id", "file_id", "path", "start_line", "end_line", "chunk_hash")
    read = checkpointed(E.verified(top.select("question_id", "rank", "chunk_id", "score").join(places, "chunk_id"), source.files().select("file_id", "content")))
    good = read.where("reason IS NULL").join(decided.where("decision <> 'insufficient'"), "question_id", "left_semi").withColumn("chars", F.length("text"))
    shown = E.admit(good.select("question_id", "rank", "chunk_id", "path", "start_line", "end_line", "text", "suspect", "chars"), "question_id", ["rank"], "chars", blocks, chars)
    shown = checkpointed(shown.withColumn("place", F.substring("evidence_id", 2, 9).cast("int")))
    block = F.struct("place", "evidence_id", "path", "start_line", "end_line", "text")
    asked = questions.join(shown.groupBy("question_id").agg(F.array_sort(F.collect_list(block)).alias("evidence")), "question_id")
    commits = C.paths(spark, folder).groupBy("repo").agg(F.max("sha").alias("sha"))
    asked = asked.join(commits, "repo", "left").withColumn("sha", F.coalesce("sha", F.lit(""))).withColumn("notes", F.array().cast("array<string>"))
    prompts = PR.built(asked)
    replies = checkpointed(model.complete(prompts, shown))
    parsed = W.parsed(replies.where("raw IS NOT NULL").withColumnRenamed("question_id", "reply_id"))
    verdicts = checkpointed(W.verdicts(parsed, shown.select(F.col("question_id").alias("reply_id"), "evidence_id", "text", "suspect")))
    said = W.answer_status(verdicts).withColumnRenamed("reply_id", "question_id")
    refused = parsed.select(F.col("reply_id").alias("question_id"), F.col("reason").alias("refused"), F.col("reply.status").alias("told"))
    j = questions.select("question_id").join(decided, "question_id", "left").join(shown.select("question_id").distinct().withColumn("has", F.lit(True)), "question_id", "left")
    j = j.join(replies.select("question_id", F.col("raw").isNull().alias("failed")), "question_id", "left").join(refused, "question_id", "left").join(said, "question_id", "left")
    status = (
        F.when(F.col("decision") == "insufficient", "insufficient_evidence").when(F.col("has").isNull(), "no_evidence").when(F.coalesce("failed", F.lit(True)), "provider_error")
        .when(F.col("refused").isNotNull(), "rejected").when(F.col("told") == "insufficient_evidence", "insufficient_evidence").otherwise(F.coalesce("answer_status", F.lit("rejected")))
    )
    reasons = F.when(F.col("refused").isNotNull(), F.array("refused")).otherwise(F.coalesce("reasons", F.array().cast("array<string>")))
    answers = j.select("question_id", status.alias("answer_status"), reasons.alias("reasons"), F.coalesce("warned", F.lit(False)).alias("warned"), (F.col("decision") == "caution").alias("caution"))
    return {"answers": answers, "claims": verdicts, "evidence": read, "prompts": prompts, "replies": replies}


def read_source(spark: SparkSession, folder: str, ranges: DataFrame, source: SourceProvider | None = None) -> DataFrame:
    """Lines of indexed files.  ranges: repo, path, start_line, end_line; adds text, null where the file is not indexed."""
    from quarrykit.operators import imports as M

    files = (source or FolderSource(spark, folder)).files()
    open_ = files.join(M.indexed(files).where("NOT excluded").select("file_id"), "file_id", "left_semi")
    j = ranges.join(open_.select("repo", "path", "content"), ["repo", "path"], "left")
    return j.withColumn("text", T.line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))).drop("content")


def checked_source(spark: SparkSession, folder: str, source: SourceProvider | None = None) -> DataFrame:
    """How many blocks of the index are still as their source says, and why the others are not: reason, blocks."""
    c = C.index_table(spark, folder, "chunks").select("chunk_id", "file_id", "start_line", "end_line", "chunk_hash")
    v = E.verified(c, (source or FolderSource(spark, folder)).files().select("file_id", "content"))
    return v.groupBy(F.coalesce("reason", F.lit("verified")).alias("reason")).agg(F.count("*").alias("blocks"))
