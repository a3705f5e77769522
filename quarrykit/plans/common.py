"""Tables of a folder in the form the operators take them."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.config import IndexConfig
from quarrykit.functions import paths as P
from quarrykit.operators import imports as M
from quarrykit.operators import index as I
from quarrykit.operators.retrieval import Corpus, Known
from quarrykit.session import stored, table
from quarrykit.sources import store


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingested_files").dropDuplicates(["file_id"]).withColumn("content", F.coalesce("content", F.lit("")))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.chunks(table(spark, d, "extracted_chunks"), table(spark, d, "ingested_files"))


def texts(spark: SparkSession, d: str, wanted: DataFrame) -> DataFrame:
    """chunk_id, text of the chunks that are wanted (chunk_id, file_id); no other text is cut or moved."""
    w = wanted.select("chunk_id", "file_id").distinct()
    ch = table(spark, d, "extracted_chunks").join(w.select("chunk_id"), "chunk_id", "left_semi")
    src = table(spark, d, "ingested_files").join(w.select("file_id").distinct(), "file_id", "left_semi")
    return I.chunks(ch, src).select("chunk_id", "text")


def repo_key(c):
    return F.trim(F.regexp_replace(F.trim(F.lower(c)), r"\.git\s*$", ""))


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").dropDuplicates(["question_id"])
    return q.select("question_id", repo_key(F.col("repo")).alias("repo"), "category", "question", "expected", "absent_terms", "added_at")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with ends cut to the file; a null or reversed end is the first line."""
    s = table(spark, d, "extracted_symbols").dropDuplicates(["symbol_id"])
    return s.withColumn("end_line", F.greatest("start_line", F.coalesce("end_line", "start_line")))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """file_id, repo, sha and path of every file, without its text."""
    return table(spark, d, "ingested_files").select("file_id", "repo", "sha", "path").dropDuplicates(["file_id"])


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    """file_id, repo, path and file_class of every file, without its text."""
    return paths(spark, d).select("file_id", "repo", "path", P.file_class(F.col("path")).alias("file_class"))


def declared_entries(spark: SparkSession, d: str) -> DataFrame:
    return index_table(spark, d, "declared")


def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    return index_table(spark, d, "imports")


_written: dict[tuple[str, str, str], DataFrame] = {}


def _stamp(spark: SparkSession, d: str) -> str:
    """What the folder holds: its size, files and last change, so that changed data is indexed anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    sum_ = fs.getContentSummary(fs.resolvePath(path))
    last = max((f.getModificationTime() for f in fs.listStatus(path)), default=0)
    return f"{d}|{sum_.getLength()}|{sum_.getFileCount()}|{last}"


def _once(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A table of the index of a folder: written once, read by every query of the application.

    It goes to the folder of ``quarrykit.index.dir``, where other applications find it as well, else to the shared
    checkpoint folder, as Parquet in both.  Rows are sorted by repository within ranges of it, so a query of one repository reads its part.
    """
    key = (spark.sparkContext.applicationId, _stamp(spark, d), name)
    if key not in _written:
        root = spark.conf.get("quarrykit.index.dir", None)
        if root:
            path = f"{root}/{hashlib.sha1(key[1].encode()).hexdigest()[:16]}"
            try:
                _written[key] = store.read_table(spark, path, name, CONFIG)
            except AnalysisException:
                store.write_table(make(), path, name, CONFIG)
                _written[key] = store.read_table(spark, path, name, CONFIG)
        else:
            _written[key] = stored(make())
    return _written[key]


CONFIG = IndexConfig()


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    return _once(spark, d, "document_postings", lambda: I.term_frequencies(docs, ["doc_id"]))


def index_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One table of the index of a folder: files, packed, chunks, postings, lengths, frequencies, stats, symbols, declared, imports, edges or entries.

    Chunks (without text), postings and lengths are views of the packed chunks.
    """
    one = lambda n: index_table(spark, d, n)
    src = table(spark, d, "ingested_files")
    named = F.when(F.col("package") == "", F.col("dir")).otherwise(F.col("package"))
    views = {
        "chunks": lambda: one("packed").drop("term_count", "terms", "tfs"),
        "postings": lambda: I.postings(one("packed")),
        "lengths": lambda: one("packed").where("term_count > 0").select("repo", "chunk_id", "term_count"),
    }
    if name in views:
        return views[name]()
    make = {
        "files": lambda: I.files(src).select("repo", "file_id", "path", "file_class"),
        "packed": lambda: I.packed(chunks(spark, d).withColumn("chars", F.length("text"))),
        "frequencies": lambda: I.document_frequencies(one("postings"), ["repo"]),
        "stats": lambda: I.packed_stats(one("packed")),
        "symbols": lambda: symbols(spark, d).select("repo", "symbol_id", "file_id", "name", "qualified_name", "start_line"),
        "declared": lambda: M.entries(M.packages(src), paths(spark, d)),
        "imports": lambda: M.resolved(M.import_rows(src), paths(spark, d), one("declared"), M.compiler_configs(src)),
        "edges": lambda: one("imports").where("target_file_id IS NOT NULL").select("repo", "file_id", "target_file_id", F.col("line").alias("edge_pos")),
        "entries": lambda: one("declared").where("entry_file_id IS NOT NULL").select("repo", F.col("entry_file_id").alias("file_id"), named.alias("package")).distinct(),
    }
    return _once(spark, d, name, make[name])


class _Lazy:
    """The tables of a corpus, each written when it is first asked for."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self._at = (spark, d)

    def __getattr__(self, name: str):
        if name == "known":
            return Known(*[index_table(*self._at, n) for n in ("lengths", "frequencies", "stats")])
        t = index_table(*self._at, name)
        return t.select("repo", "chunk_id", "file_id", "start_line", "end_line") if name == "chunks" else t


def corpus(spark: SparkSession, d: str) -> Corpus | _Lazy:
    """The index of a folder, as ``retrieval.Corpus``."""
    return _Lazy(spark, d)
