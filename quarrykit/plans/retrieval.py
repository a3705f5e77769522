"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.config import SearchOptions
from quarrykit.functions import text as T
from quarrykit.operators import retrieval as R
from quarrykit.operators import scoring as X
from quarrykit.plans import common as C
from quarrykit.plans import dialect as D
from quarrykit.plans.text import PLACED
from quarrykit.session import stored, table


def _passages(s, d):
    """Every passage as a question over all documents: BM25, the best ten."""
    docs = table(s, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    post = C.document_postings(s, d)
    terms = table(s, d, "eval_passages").select("item_id", F.explode(T.question_terms(F.col("text"))).alias("term"))
    hits = R.bm25(terms, post, docs.select("doc_id"), [], "doc_id", "item_id")
    scored = hits.groupBy("item_id", "doc_id").agg(F.round(F.sum("weight"), 9).alias("score"))
    return R.top_k(scored, "item_id", "doc_id", 10).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def lexical_top(s, d):
    """Questions over the chunks of their repository, by terms alone: three chunks of a file at most, ten of a question, with their place."""
    q = C.questions(s, d).select("repo", "question_id", T.question_terms(F.col("question")).alias("terms"))
    got = X.lexical(C.index_table(s, d, "packed"), q, C.index_table(s, d, "frequencies"), C.index_table(s, d, "stats"), 3, 10, 9)
    c = C.index_table(s, d, "chunks").select("chunk_id", "path", "start_line", "end_line")
    top = R.top_k(got, "question_id", "chunk_id", 10).join(c, "chunk_id")
    return top.select("question_id", "rank", "chunk_id", "file_id", "path", "start_line", "end_line", "terms", F.round("score", 6).alias("score"))


LEXICAL = f"""c AS (SELECT * FROM {D.CHUNKS}), q AS (SELECT * FROM {D.QUESTIONS}), qt AS (SELECT repo, question_id, term FROM {D.question_terms('q', 'question_id', 'question')} JOIN q USING (question_id)),
{D.bm25('c', 'chunk_id', 'repo', 'qt', 'question_id')},
lex AS (SELECT question_id, chunk_id, round(sum(weight), 9) AS score, count(*) AS terms FROM hits GROUP BY question_id, chunk_id),
cap AS (SELECT * FROM (SELECT l.*, c.file_id, c.path, c.start_line, c.end_line, row_number() OVER (PARTITION BY question_id, c.file_id ORDER BY score DESC, chunk_id) AS r FROM lex l JOIN c USING (chunk_id)) WHERE r <= 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cap) WHERE rank <= 10)"""


def _symbol_chunks(s, d):
    return R.symbol_chunks(C.symbols(s, d), C.index_table(s, d, "chunks")).select("symbol_id", "chunk_id")


def _path_hits(s, d):
    """The best ten files of every question by the terms of their paths."""
    q = C.questions(s, d).select("repo", "question_id", T.question_terms(F.col("question")).alias("terms"))
    got = R.path_files(q, C.index_table(s, d, "files"), SearchOptions())
    return got.select("question_id", "file_id", "rank", F.round("path", 6).alias("score"))


def _search(s, d):
    return R.search(C.questions(s, d), C.corpus(s, d)).withColumn("names", F.array_join("names", " "))


def _control(s, d):
    """All switches but the lexical lane off."""
    o = SearchOptions(symbols=False, paths=False, import_expansion=False, entry_boost=False, class_weights={})
    r = R.search(C.questions(s, d), C.corpus(s, d), o)
    return r.select("question_id", "rank", "chunk_id", "score")


def features(s, d):
    c, q = C.corpus(s, d), C.questions(s, d)
    return R.features(q, stored(R.search(q, c)), c)


def _features(s, d):
    return features(s, d).withColumn("decision", R.decision(F.col("idf_coverage"), F.col("evidence")))


QUERIES = {
    "search_bm25_top10": _passages,
    "search_lexical_top10": lexical_top,
    "search_symbol_chunks": _symbol_chunks,
    "search_path_hits": _path_hits,
    "search_control": _control,
    "search_fused_top10": _search,
    "search_features": _features,
}

SQL = {
    "search_bm25_top10": f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), qt AS (SELECT item_id, term FROM {D.question_terms('eval_passages', 'item_id', 'text')}), {D.bm25('docs', 'doc_id', '', 'qt', 'item_id')},
s AS (SELECT item_id, doc_id, round(sum(weight), 9) AS score FROM hits GROUP BY item_id, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "search_lexical_top10": f"WITH {LEXICAL} SELECT question_id, rank, chunk_id, file_id, path, start_line, end_line, terms, round(score, 6) AS score FROM top",
    "search_symbol_chunks": f"SELECT symbol_id, chunk_id FROM {PLACED}",
    "search_path_hits": f"""WITH f AS (SELECT file_id, repo, path FROM {D.FILES}), q AS (SELECT * FROM {D.QUESTIONS}), qt AS (SELECT repo, question_id, term FROM {D.question_terms('q', 'question_id', 'question')} JOIN q USING (question_id)),
p AS (SELECT DISTINCT repo, file_id, term FROM (SELECT repo, file_id, {D.stem('t')} AS term FROM (SELECT repo, file_id, unnest({D.split_identifier("regexp_replace(seg, '[.][A-Za-z0-9]+$', '')")}) AS t FROM (SELECT repo, file_id, unnest(string_split(path, '/')) AS seg FROM f))) WHERE length(term) >= 2),
df AS (SELECT repo, term, count(*) AS df FROM p GROUP BY repo, term), n AS (SELECT repo, count(*) AS files FROM f GROUP BY repo),
w AS (SELECT repo, question_id, term, ln(1.0 + (files - df + 0.5) / (df + 0.5)) AS w FROM qt JOIN df USING (repo, term) JOIN n USING (repo)), t AS (SELECT question_id, sum(w) AS total FROM w GROUP BY question_id),
g AS (SELECT question_id, file_id, round(sum(w) / any_value(total), 9) AS score FROM w JOIN p USING (repo, term) JOIN t USING (question_id) GROUP BY question_id, file_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_id) AS rank FROM g) SELECT question_id, file_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "search_control": f"""WITH {LEXICAL}, m AS (SELECT question_id, max(round(score, 12)) AS most FROM lex GROUP BY question_id), n AS (SELECT l.question_id, l.chunk_id, c.file_id, l.score / most AS score FROM lex l JOIN m USING (question_id) JOIN c USING (chunk_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, file_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM n), z AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM k WHERE r <= 3)
SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM z WHERE rank <= 10""",
}
