"""Building an index: files, chunks, term frequencies, postings and corpus statistics.

Tables stay text-free after this point; text is read late, from the file table.
Repeated rows of a key count once; null content counts as empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit import config as C
from quarrykit.functions import paths as P
from quarrykit.functions import text as T
from quarrykit.session import ship


def files(ingested: DataFrame) -> DataFrame:
    """One row per file with its line count and classes, without text."""
    c = F.coalesce("content", F.lit(""))
    return ingested.dropDuplicates(["file_id"]).select(
        "file_id", "build_id", "repo", "sha", "path", P.language_of(F.col("path")).alias("language"), P.file_class(F.col("path")).alias("file_class"),
        T.line_count(c).alias("line_count"), F.length(c).alias("chars"),
    )


def windows(line_count: Column, size: int = C.WINDOW_LINES) -> Column:
    """Fixed windows of lines 1..n as an array of (start_line, end_line); empty for no lines."""
    starts = F.when(line_count > 0, F.sequence(F.lit(1), F.greatest(line_count, F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start_line"), F.least(line_count, s + size - 1).alias("end_line")))


def split_oversized(start: Column, end: Column, size: int = C.WINDOW_LINES) -> Column:
    """A unit start..end in fixed windows."""
    starts = F.when(end >= start, F.sequence(start, F.greatest(start, end), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start_line"), F.least(end, s + size - 1).alias("end_line")))


def merge_units(units: Column, line_count: Column) -> Column:
    """Units (start, end) merged from the top into chunks that cover every line exactly once.

    A chunk of less than the minimum takes the next unit while both stay within the maximum;
    overlapping units always merge; lines between units go to the chunk after them, the rest
    to the last.  No units: fixed windows; no lines: none.
    """
    unit = "array<struct<start:int,end:int>>"
    empty = F.array().cast(unit)
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    small = lambda acc, u: (last(acc)["end"] - last(acc)["start"] + 1 < C.MIN_CHUNK_LINES) & (u["end"] - last(acc)["start"] + 1 <= C.MAX_CHUNK_LINES)
    merged = F.aggregate(
        F.array_sort(units.cast(unit)),
        empty,
        lambda acc, u: F.when(
            (F.size(acc) > 0) & (small(acc, u) | (u["start"] <= last(acc)["end"])),
            F.array_append(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], u["end"]).alias("end")),
            ),
        ).otherwise(F.array_append(acc, F.struct(u["start"].alias("start"), u["end"].alias("end")))),
    )
    ends = F.transform(merged, lambda u, i: F.when(i == F.size(merged) - 1, line_count).otherwise(F.least(line_count, u["end"])))
    cover = F.aggregate(
        ends,
        F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<start_line:int,end_line:int>>").alias("out")),
        lambda a, e: F.when(e < a["next"], a).otherwise(
            F.struct((e + 1).alias("next"), F.array_append(a["out"], F.struct(a["next"].alias("start_line"), e.alias("end_line"))).alias("out"))
        ),
    )["out"]
    none = F.array().cast("array<struct<start_line:int,end_line:int>>")
    return F.when(line_count <= 0, none).when(F.size(units) == 0, windows(line_count)).otherwise(cover)


def chunks(extracted: DataFrame, ingested: DataFrame) -> DataFrame:
    """Chunks cut to the lines that exist, with text, fingerprint and terms.

    A null end is the end of the file; chunks that begin after it are left out.
    """
    content = F.coalesce("content", F.lit(""))
    src = ingested.dropDuplicates(["file_id"]).select("file_id", "path", T.lines(content).alias("lines"), T.line_count(content).alias("n"))
    n = F.col("n")
    # a file is split into lines once, before the join, not once for each of its chunks
    c = extracted.dropDuplicates(["chunk_id"]).join(src, "file_id").withColumn("end_line", F.least(F.coalesce("end_line", n), n))
    c = c.where(F.col("start_line") <= F.col("end_line"))
    block = F.array_join(F.slice("lines", F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.greatest("start_line", F.lit(1)) + 1, F.lit(0))), "\n")
    return c.select("chunk_id", "file_id", "repo", "path", "start_line", "end_line", block.alias("text")).withColumn("chunk_hash", T.fingerprint(F.col("text")))


def term_frequencies(blocks: DataFrame, keys: list[str], text: str = "text", verbs: bool = False) -> DataFrame:
    """keys, term, tf.

    Rows are exploded to identifiers and then to parts before anything is computed, so that every
    expression is a scalar of generated code; ``functions.text.terms`` says the same of one text.
    """
    ids = blocks.select(*keys, F.explode(T.identifiers(F.col(text))).alias("id"))
    parts = F.regexp_replace(F.regexp_replace("id", "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.trim(F.regexp_replace(F.lower(parts), "[^a-z0-9]+", " "))
    named = ids.select(*keys, F.lower("id").alias("id"), parts.alias("parts"))
    whole = F.when(F.instr("parts", " ") > 0, F.concat(F.regexp_replace("id", "[^a-z0-9]", ""), F.lit(" "), F.col("parts"))).otherwise(F.col("parts"))
    each = named.select(*keys, F.explode(F.split(whole, " ")).alias("part")).where("part <> ''")
    found = each.select(*keys, T.stem(F.col("part"), verbs).alias("term")).where(T.keep(F.col("term")))
    return found.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


_IDENTIFIER = re.compile(T.IDENTIFIER)
_CAMEL, _ACRONYM, _OTHER = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])"), re.compile("[^a-z0-9]+")
_STOP = frozenset(C.CODE_STOPWORDS + C.ENGLISH_STOPWORDS)
_terms: dict[str, tuple[str, ...]] = {}


def _stem(t: str) -> str:
    n = len(t)
    if n > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if n > 4 and t.endswith("sses"):
        return t[:-2]
    return t[:-1] if n > 3 and t.endswith("s") and not t.endswith(("ss", "us", "is")) else t


def _identifier_terms(name: str) -> tuple[str, ...]:
    """``functions.text.identifier_terms`` of one identifier; most of a corpus are repetitions, so they are kept."""
    got = _terms.get(name)
    if got is None:
        if len(_terms) >= 200_000:
            _terms.clear()
        parts = [x for x in _OTHER.split(_ACRONYM.sub(r"\1 \2", _CAMEL.sub(r"\1 \2", name)).lower()) if x]
        whole = [_OTHER.sub("", name.lower())] if len(parts) > 1 else []
        got = _terms[name] = tuple(t for t in map(_stem, whole + parts) if 2 <= len(t) <= C.MAX_TERM and t not in _STOP)
    return got


def _packed_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        terms, tfs, counts = [], [], []
        for text in b.text:
            tf: dict[str, int] = {}
            for name, n in Counter(_IDENTIFIER.findall(text)).items():
                for t in _identifier_terms(name):
                    tf[t] = tf.get(t, 0) + n
            own = sorted(tf)
            terms.append(" ".join(own))
            tfs.append([tf[t] for t in own])
            counts.append(sum(tf.values()))
        yield b.drop(columns="text").assign(term_count=counts, terms=terms, tfs=tfs)


def packed(blocks: DataFrame) -> DataFrame:
    """Blocks with their terms instead of their text: term_count, terms (parted by blanks) and tfs; one row for each block, no shuffle.

    The terms are those of ``term_frequencies``.
    """
    ship(blocks.sparkSession)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "text")
    return blocks.mapInPandas(_packed_batches, f"{kept}, term_count BIGINT, terms STRING, tfs ARRAY<INT>")


def packed_postings(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same rows from postings: repo, chunk_id, term, tf."""
    g = postings.groupBy("repo", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf")))).alias("t"), F.sum("tf").alias("term_count"))
    j = chunks.join(g, ["repo", "chunk_id"], "left").withColumn("term_count", F.coalesce("term_count", F.lit(0)))
    return j.withColumn("terms", F.coalesce(F.array_join("t.term", " "), F.lit(""))).withColumn("tfs", F.coalesce("t.tf", F.array().cast("array<int>"))).drop("t")


def postings(packed_: DataFrame) -> DataFrame:
    """repo, chunk_id, term, tf of packed blocks."""
    each = packed_.where("term_count > 0").select("repo", "chunk_id", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))).alias("t"))
    return each.select("repo", "chunk_id", "t.term", F.col("t.tf").cast("bigint").alias("tf"))


def packed_stats(packed_: DataFrame) -> DataFrame:
    """Blocks and their mean length for each repository; a block without terms has length 0."""
    return packed_.groupBy("repo").agg(F.count("*").alias("blocks"), F.avg("term_count").alias("mean_length"))


def document_frequencies(postings: DataFrame, keys: list[str]) -> DataFrame:
    """How many blocks hold a term; ``keys`` partition the corpora."""
    return postings.groupBy(*keys, "term").agg(F.count("*").alias("df"))


def lengths(postings: DataFrame, keys: list[str]) -> DataFrame:
    return postings.groupBy(*keys).agg(F.sum("tf").alias("term_count"))


def corpus_stats(blocks: DataFrame, lengths_: DataFrame, corpus: list[str], block: str) -> DataFrame:
    """Blocks and their mean length for each corpus; a block without terms has length 0."""
    j = blocks.select(*corpus, block).join(lengths_.select(*corpus, block, "term_count"), [*corpus, block], "left")
    return j.groupBy(*corpus).agg(F.count("*").alias("blocks"), F.avg(F.coalesce("term_count", F.lit(0))).alias("mean_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25_weight(idf_: Column, tf: Column, length: Column, mean: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    norm = F.when(mean > 0, mean).otherwise(1.0)
    return idf_ * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / norm))
