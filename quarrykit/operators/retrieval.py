"""Retrieval for many questions at once: lexical, symbol, path and entry lanes, fusion, expansion over
the import graph, a cap for each file and the top k.

Everything is partitioned by (repo) or (question, chunk); ties go to the smaller chunk id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.config import ENTRY_TERMS, SearchOptions
from quarrykit.functions import paths as P
from quarrykit.functions import text as T
from quarrykit.operators import index as I
from quarrykit.operators import scoring as X
from quarrykit.session import stored


@dataclass
class Known:
    """What follows from the postings of an index; kept with it, else worked out for each search."""

    lengths: DataFrame  # corpus, block, term_count
    frequencies: DataFrame  # corpus, term, df
    stats: DataFrame  # corpus, blocks, mean_length


def _known(postings: DataFrame, blocks: DataFrame, corpus: list[str], block: str) -> Known:
    length = I.lengths(postings, [*corpus, block])
    return Known(length, I.document_frequencies(postings, corpus), I.corpus_stats(blocks, length, corpus, block))


@dataclass
class Corpus:
    """Tables of an index.  All carry ``repo``; ids are unique over repositories."""

    files: DataFrame  # repo, file_id, path, file_class
    chunks: DataFrame  # repo, chunk_id, file_id, start_line, end_line
    postings: DataFrame  # repo, chunk_id, term, tf
    symbols: DataFrame  # repo, symbol_id, file_id, name, qualified_name, start_line
    edges: DataFrame  # repo, file_id, target_file_id, edge_pos
    entries: DataFrame  # repo, file_id, package
    known: Known | None = None
    packed: DataFrame | None = None  # repo, chunk_id, file_id, term_count, terms, tfs


def analysed(questions: DataFrame, options: SearchOptions) -> DataFrame:
    """questions: repo, question_id, question -> terms, identifiers, flags."""
    q = questions.withColumn("intent", P.entry_intent(F.col("question")) & F.lit(options.entry_boost))
    drop = lambda c: F.when(F.col("intent"), F.filter(c, lambda t: ~t.isin(ENTRY_TERMS))).otherwise(c)
    return q.select(
        "repo", "question_id", "intent", P.wants_non_source(F.col("question")).alias("any_class"),
        drop(T.question_terms(F.col("question"))).alias("terms"), drop(T.question_identifiers(F.col("question"))).alias("identifiers"),
    )


def bm25(terms: DataFrame, postings: DataFrame, blocks: DataFrame, corpus: list[str], block: str, query: str, o: SearchOptions = SearchOptions(), known: Known | None = None) -> DataFrame:
    """query, block, term, weight: the BM25 share of every matched term.

    terms: corpus, query, term (distinct).  The terms are the small side: postings are not
    shuffled by term where the terms can be broadcast.
    """
    k = known or _known(postings, blocks, corpus, block)
    length, stats = k.lengths, k.stats
    t = terms.join(k.frequencies, [*corpus, "term"])
    hit = postings.join(t, [*corpus, "term"]).join(length, [*corpus, block])
    hit = hit.join(stats, corpus) if corpus else hit.crossJoin(F.broadcast(stats))
    weight = I.bm25_weight(I.idf(F.col("blocks"), F.col("df")), F.col("tf"), F.col("term_count"), F.col("mean_length"), o.k1, o.b)
    return hit.select(*corpus, query, block, "term", weight.alias("weight"))


def top_k(scored: DataFrame, query: str, block: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(block))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def capped_top_k(scored: DataFrame, query: str, group: str, block: str, per_group: int, k: int) -> DataFrame:
    """At most ``per_group`` rows of a group, then the best k of a query."""
    order = [F.desc("score"), F.asc(block)]
    capped = scored.withColumn("in_group", F.row_number().over(Window.partitionBy(query, group).orderBy(*order))).where(F.col("in_group") <= per_group)
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k).drop("in_group")


def symbol_rows(c: Corpus, df: DataFrame, stats: DataFrame) -> DataFrame:
    """repo, chunk_id, shown, names, parts, weights: every symbol in its chunk, with its names and the idf of its parts."""
    s = symbol_chunks(c.symbols, c.chunks)
    shown = F.coalesce("qualified_name", "name")
    parts = F.array_distinct(F.filter(F.transform(T.split_identifier(F.col("name")), lambda t: T.stem(t)), lambda t: F.length(t) >= 2))
    terms = s.select("repo", "symbol_id", F.explode(parts).alias("term")).join(df.select("repo", "term", "df"), ["repo", "term"], "left").join(F.broadcast(stats), "repo")
    g = terms.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("term", I.idf(F.col("blocks"), F.coalesce("df", F.lit(0))).alias("w")))).alias("p"))
    j = s.select("symbol_id", "repo", "chunk_id", shown.alias("shown"), F.array_compact(F.array_distinct(F.array(F.lower("name"), F.lower(shown)))).alias("names")).join(g, "symbol_id", "left")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return j.select("repo", "chunk_id", "shown", F.coalesce("names", empty("string")).alias("names"), F.coalesce("p.term", empty("string")).alias("parts"), F.coalesce("p.w", empty("double")).alias("weights"))


def symbol_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk that holds the first line of a symbol: an equi-join on the file with a range; of several
    chunks the one that begins last, then the smaller id."""
    s = symbols.alias("s").join(chunks.alias("c"), (F.col("s.file_id") == F.col("c.file_id")) & F.col("s.start_line").between(F.col("c.start_line"), F.col("c.end_line")))
    return s.groupBy("s.symbol_id").agg(
        F.first("s.repo").alias("repo"), F.first("s.file_id").alias("file_id"), F.first("s.name").alias("name"), F.first("s.qualified_name").alias("qualified_name"),
        F.min_by("c.chunk_id", F.struct(-F.col("c.start_line"), "c.chunk_id")).alias("chunk_id"),
    )


def path_files(q: DataFrame, files: DataFrame, o: SearchOptions) -> DataFrame:
    """question_id, file_id, path, rank: the best files of every question by the terms of their paths.  q: repo, question_id, terms."""
    f = files.select("repo", "file_id", T.path_terms(F.col("path")).alias("terms"))
    df = f.select("repo", F.explode("terms").alias("term")).groupBy("repo", "term").agg(F.count("*").alias("df"))
    n = files.groupBy("repo").agg(F.count("*").alias("blocks"))
    t = q.select("repo", "question_id", F.posexplode("terms").alias("pos", "term")).join(df, ["repo", "term"]).join(F.broadcast(n), "repo")
    w = t.groupBy("repo", "question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", I.idf(F.col("blocks"), F.col("df")).alias("idf")))).alias("t"))
    got = X.path_files(w.select("repo", "question_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs")), f, n, o.path_files)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("path"), "file_id"))
    return got.withColumn("rank", place).where(F.col("rank") <= o.path_files)


def entry_rows(c: Corpus) -> DataFrame:
    """repo, chunk_id, labels: the first chunk of every declared entry file, with the terms of its package and path."""
    first = c.chunks.groupBy("file_id").agg(F.min_by("chunk_id", F.struct("start_line", "chunk_id")).alias("chunk_id"))
    return c.entries.join(c.files.select("file_id", "path"), "file_id").join(first, "file_id").select(
        "repo", "chunk_id", F.array_distinct(F.concat(T.path_terms(F.coalesce("package", F.lit(""))), T.path_terms(F.col("path")))).alias("labels")
    )


def lane_rows(c: Corpus, packed: DataFrame, k: Known, o: SearchOptions) -> DataFrame:
    """All that the lanes need, as ``scoring.ROWS`` with the block of the file: packed chunks, places of chunks, symbols, entries."""
    at = c.chunks.select(F.col("repo").alias("own"), "chunk_id", "file_id").join(c.files.select("file_id", "file_class", F.col("repo").alias("of_file")), "file_id")
    parts = [
        packed.select("repo", F.lit(X.PACKED).alias("kind"), "chunk_id", "file_id", "term_count", "terms", "tfs"),
        # a chunk whose file is of another repository is found by the paths of that one
        at.select(F.explode(F.array_distinct(F.array("own", "of_file"))).alias("repo"), F.lit(X.PLACE).alias("kind"), "chunk_id", "file_id", "file_class"),
    ]
    info = at.select("chunk_id", "file_id", "file_class")
    if o.symbols:
        parts.append(symbol_rows(c, k.frequencies, k.stats).join(info, "chunk_id").withColumn("kind", F.lit(X.SYMBOL)))
    if o.entry_boost:
        parts.append(entry_rows(c).join(info, "chunk_id").withColumn("kind", F.lit(X.ENTRY)))
    empty = c.chunks.sparkSession.createDataFrame([], X.ROWS)
    u = empty
    for p in parts:
        u = u.unionByName(p, allowMissingColumns=True)
    return X.placed(u.select(*empty.columns), k.stats)


def search(questions: DataFrame, c: Corpus, o: SearchOptions = SearchOptions()) -> DataFrame:
    """question_id, rank, chunk_id, file_id, score and the signals of the best chunks of every question.

    Lanes meet inside the blocks of a repository (see ``scoring``).  Of each block come the best chunks under the cap of
    a file and the seeds of the expansion; an expansion can only raise the best lexical chunks of the seeds'
    neighbours, which are asked for by their files, so these rows hold the best of all.
    """
    q = analysed(questions, o)
    k = c.known or _known(c.postings, c.chunks, ["repo"], "chunk_id")
    packed = c.packed if c.packed is not None else I.packed_postings(c.postings, c.chunks.select("repo", "chunk_id", "file_id"))
    qs = X.asked(q, k.frequencies, k.stats)
    none = F.array()
    if o.paths:
        best = path_files(q, c.files, o).groupBy("question_id").agg(F.collect_list(F.struct("file_id", "path")).alias("f"))
        qs = qs.join(best, "question_id", "left")
        files, scores = F.coalesce("f.file_id", none.cast("array<bigint>")), F.coalesce("f.path", none.cast("array<double>"))
    else:
        files, scores = none.cast("array<bigint>"), none.cast("array<double>")
    qs = stored(qs.select("repo", "question_id", "terms", "idfs", "mean", "intent", "any_class", "identifiers", files.alias("path_files"), scores.alias("path_scores")))
    qs = qs.join(X.most(packed, qs, k.stats, o), "question_id", "left")
    if o.import_expansion:
        qs = stored(qs)
    rows = lane_rows(c, packed, k, o)
    nothing = {"near": F.lit(None).cast("array<bigint>"), "parents": F.lit(None).cast("array<double>")}
    ranked = X.signals(rows, X.everywhere(qs.withColumns(nothing), k.stats), o)
    if o.import_expansion:
        ranked = expanded(stored(ranked), rows, qs, c.edges, k.stats, o)
    return capped_top_k(ranked, "question_id", "file_id", "chunk_id", o.per_file, o.k).select(
        "question_id", "rank", "chunk_id", "file_id", F.round("score", 6).alias("score"), F.round("bm25", 6).alias("bm25"), F.round("symbol", 6).alias("symbol"),
        F.round("path", 6).alias("path"), F.round("entry", 6).alias("entry"), "names",
    )


def neighbours(seeds: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """One hop over the import graph in both directions: question_id, file_id, score.

    seeds: question_id, file_id, seed, score.  Files of seeds are no neighbours; the first
    ``limit`` files in the order of the seeds (imports before importers) count.
    """
    out = edges.select("file_id", F.col("target_file_id").alias("near"), F.struct(F.lit(0).alias("d"), "edge_pos").alias("o"))
    back = edges.select(F.col("target_file_id").alias("file_id"), F.col("file_id").alias("near"), F.struct(F.lit(1).alias("d"), "edge_pos").alias("o"))
    hop = seeds.join(out.unionByName(back), "file_id").select("question_id", F.col("near").alias("file_id"), "score", F.struct("seed", "o").alias("o"))
    hop = hop.join(seeds.select("question_id", "file_id").distinct(), ["question_id", "file_id"], "left_anti")
    best = hop.groupBy("question_id", "file_id").agg(F.min("o").alias("o"), F.max("score").alias("score"))
    r = F.row_number().over(Window.partitionBy("question_id").orderBy("o", "file_id"))
    return best.withColumn("r", r).where(F.col("r") <= limit).select("question_id", "file_id", "score")


def expanded(ranked: DataFrame, rows: DataFrame, qs: DataFrame, edges: DataFrame, stats: DataFrame, o: SearchOptions) -> DataFrame:
    """Adds the import bonus: a neighbour's best lexical chunk gains a share of its seed's score."""
    r = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
    seeds = ranked.withColumn("seed", r).where(F.col("seed") <= o.import_seeds).select("question_id", "file_id", "seed", "score")
    near = neighbours(seeds, edges, o.max_neighbours).join(qs.select("question_id", "repo"), "question_id")
    near = X.placed(near, stats).groupBy("question_id", "block").agg(F.collect_list(F.struct("file_id", "score")).alias("n"))
    near = near.select("question_id", "block", F.col("n.file_id").alias("near"), F.col("n.score").alias("parents"))
    both = ranked.unionByName(X.signals(rows, qs.join(near, "question_id"), o))
    signals = ["file_id", "score", "bm25", "symbol", "path", "entry", "names"]
    j = both.groupBy("question_id", "chunk_id").agg(*[F.first(x).alias(x) for x in signals], F.max("bonus").alias("bonus"))
    return j.withColumn("score", F.round(F.greatest("score", F.col("score") + F.col("bonus")), 12)).drop("bonus")


def features(questions: DataFrame, results: DataFrame, c: Corpus, o: SearchOptions = SearchOptions()) -> DataFrame:
    """Abstention features of every question: top score, margin, idf coverage of the top 3 and top 1, flags and counts."""
    q = analysed(questions, o)
    k = c.known or _known(c.postings, c.chunks, ["repo"], "chunk_id")
    df, stats = k.frequencies, k.stats
    terms = q.select("repo", "question_id", F.explode("terms").alias("term")).join(df, ["repo", "term"], "left").join(stats, "repo").select(
        "repo", "question_id", "term", I.idf(F.col("blocks"), F.coalesce("df", F.lit(0))).alias("w")
    )
    total = terms.groupBy("question_id").agg(F.sum("w").alias("total"))
    top = results.where("rank <= 3").select("question_id", "chunk_id", "rank")
    packed = c.packed if c.packed is not None else I.packed_postings(c.postings, c.chunks.select("repo", "chunk_id", "file_id"))
    held = packed.select("repo", "chunk_id", F.split("terms", " ").alias("held")).join(top.select("chunk_id").distinct(), "chunk_id", "left_semi")
    asked = q.select("repo", "question_id", "terms").join(top, "question_id").join(held, ["repo", "chunk_id"])
    own = asked.select("question_id", "rank", F.explode(F.array_intersect("terms", "held")).alias("term"))
    seen = terms.join(own, ["question_id", "term"])
    cover = seen.groupBy("question_id", "term").agg(F.first("w").alias("w"), F.min("rank").alias("r")).groupBy("question_id").agg(
        F.sum("w").alias("w3"), F.sum(F.when(F.col("r") == 1, F.col("w")).otherwise(0.0)).alias("w1")
    )
    rows = results.groupBy("question_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("rank") <= 3, F.col("symbol") >= 1.5)).alias("exact_symbol"), F.max(F.when(F.col("rank") == 1, F.col("path") > 0)).alias("path_hit"),
        F.count("*").alias("evidence"),
    )
    j = q.select("question_id", F.size("terms").alias("term_count"), F.size("identifiers").alias("identifier_count"))
    for part in (rows, total, cover):
        j = j.join(part, "question_id", "left")
    share = lambda x: F.round(F.when(F.col("total") > 0, F.coalesce(x, F.lit(0.0)) / F.col("total")).otherwise(0.0), 6)
    return j.select(
        "question_id", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.round(F.coalesce("top_score", F.lit(0.0)) - F.coalesce("second", F.lit(0.0)), 6).alias("margin"),
        share(F.col("w3")).alias("idf_coverage"), share(F.col("w1")).alias("top1_coverage"), F.coalesce("exact_symbol", F.lit(False)).alias("exact_symbol"),
        F.coalesce("path_hit", F.lit(False)).alias("path_hit"), F.coalesce("evidence", F.lit(0)).alias("evidence"), "term_count", "identifier_count",
    )


def decision(coverage: Column, evidence: Column, low: float = 0.3, high: float = 0.5) -> Column:
    """What to do with a question: decline, answer with caution, or answer."""
    return F.when((evidence == 0) | (coverage < low), "insufficient").when(coverage < high, "caution").otherwise("answer")
