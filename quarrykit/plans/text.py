"""Queries of tokenising, text scalars and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import index as I
from quarrykit.plans import common as C
from quarrykit.plans import dialect as D
from quarrykit.session import table



def _document_terms(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    return I.term_frequencies(t, ["doc_id"])


def _name_parts(s, d):
    n = table(s, d, "extracted_symbols").select("name").distinct()
    v = T.fold_verb(T.fold_plural(F.lower("name")))
    return n.select("name", F.array_join(T.split_identifier(F.col("name")), " ").alias("parts"), F.array_join(T.identifier_terms(F.col("name")), " ").alias("terms"), v.alias("verb_stem"))


_VERB = "CASE WHEN {b} IS NULL THEN {t} WHEN right({b}, 1) = substr({b}, length({b}) - 1, 1) AND right({b}, 1) NOT IN ('a','e','i','o','u') AND right({b}, 2) NOT IN ('ss','ll','ff') THEN left({b}, length({b}) - 1) ELSE {b} END"


def _question_terms(s, d):
    q = C.questions(s, d)
    return q.select("question_id", F.array_join(T.question_terms(F.col("question")), " ").alias("terms"))


def _question_names(s, d):
    q = C.questions(s, d)
    return q.select("question_id", F.array_join(F.array_sort(T.question_identifiers(F.col("question"))), " ").alias("identifiers"))


def _windows(s, d):
    f = C.sources(s, d)
    w = f.select("file_id", F.explode(I.windows(T.line_count(F.col("content")))).alias("w"))
    return w.select("file_id", F.col("w.start_line").alias("start_line"), F.col("w.end_line").alias("end_line"))


def _unit_windows(s, d):
    x = C.symbols(s, d).where("end_line - start_line + 1 > 80")
    return x.select("symbol_id", F.explode(I.split_oversized(F.col("start_line"), F.col("end_line"))).alias("w")).select("symbol_id", F.col("w.start_line").alias("start_line"), F.col("w.end_line").alias("end_line"))


def _merged(s, d):
    """Chunks rebuilt from the top-level symbols of every file; a file's units are bounded by its lines."""
    f = I.files(table(s, d, "ingested_files")).select("file_id", "line_count")
    u = C.symbols(s, d).where("parent IS NULL").join(f, "file_id").where("start_line <= line_count").withColumn("end_line", F.least("end_line", "line_count"))
    g = u.groupBy("file_id", "line_count").agg(F.collect_set(F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end"))).alias("units"))
    m = g.select("file_id", F.explode(I.merge_units(F.col("units"), F.col("line_count"))).alias("w"))
    return m.select("file_id", F.col("w.start_line").alias("start_line"), F.col("w.end_line").alias("end_line"))


def _hashes(s, d):
    return C.index_table(s, d, "chunks").select("chunk_id", "end_line", "chunk_hash", "chars")


def _vocabulary(s, d):
    p = C.index_table(s, d, "postings")
    return p.groupBy("repo", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def _stats(s, d):
    c = C.index_table(s, d, "chunks")
    st = I.corpus_stats(c.select("repo", "chunk_id"), C.index_table(s, d, "lengths"), ["repo"], "chunk_id")
    return st.select("repo", "blocks", F.round("mean_length", 6).alias("mean_length"))


def _links(s, d):
    c = C.index_table(s, d, "chunks").join(C.sources(s, d).select("file_id", "sha"), "file_id")
    return c.select("chunk_id", T.permalink(F.col("repo"), F.col("sha"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("link"))


def _quotes(s, d):
    """Whether the first line of every symbol, quoted with its number, stands in the chunk that holds it."""
    from quarrykit.operators.retrieval import symbol_chunks

    c = C.chunks(s, d)
    placed = symbol_chunks(C.symbols(s, d), c).select("symbol_id", "chunk_id")
    sym = C.symbols(s, d).select("symbol_id", "file_id", "start_line")
    src = C.sources(s, d).select("file_id", "content")
    j = placed.join(sym, "symbol_id").join(src, "file_id").join(c.select("chunk_id", "text"), "chunk_id")
    line = T.line_slice(F.col("content"), F.col("start_line"), F.col("start_line"))
    quote = F.concat(F.lit("L"), F.col("start_line").cast("string"), F.lit("| "), line)
    return j.select("symbol_id", F.length(T.trim_quote(F.col("text"))).alias("kept"), T.quote_is_verbatim(quote, F.col("text")).alias("verbatim"))


def _durations(s, d):
    e = table(s, d, "events").select("event_id", F.concat(F.floor("value").cast("string"), F.lit("m"), F.pmod("event_id", F.lit(60)).cast("string"), F.lit(".5s")).alias("t"))
    return e.select("event_id", T.duration_ms(F.col("t")).alias("ms"), (T.duration_ms(F.lit("soon")).isNull()).alias("none"))


QUERIES = {
    "text_document_terms": _document_terms,
    "text_identifier_parts": _name_parts,
    "text_question_terms": _question_terms,
    "text_question_identifiers": _question_names,
    "text_path_terms": lambda s, d: C.sources(s, d).select("file_id", F.array_join(T.path_terms(F.col("path")), " ").alias("terms")),
    "chunk_windows": _windows,
    "chunk_split_oversized": _unit_windows,
    "chunk_merge_units": _merged,
    "chunk_fingerprints": _hashes,
    "index_vocabulary": _vocabulary,
    "index_corpus_stats": _stats,
    "text_permalinks": _links,
    "text_quote_verbatim": _quotes,
    "text_durations": _durations,
}

_HEAD = "length(regexp_extract(left(text, 400), '^([\\s\\S]*)\\n', 1))"
_TRIM = f"CASE WHEN length(text) <= 400 THEN length(text) WHEN {_HEAD} > 0 THEN {_HEAD} ELSE 400 END"
_B = "CASE WHEN ends_with(p, 'ing') THEN CASE WHEN length(p) - 3 >= 4 THEN left(p, length(p) - 3) END WHEN ends_with(p, 'ed') THEN CASE WHEN length(p) - 2 >= 4 THEN left(p, length(p) - 2) END END"
_WS = "[\\s\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
PLACED = f"""(SELECT symbol_id, file_id, start_line, chunk_id, text FROM (
  SELECT s.symbol_id, s.file_id, s.start_line, c.chunk_id, c.text, row_number() OVER (PARTITION BY s.symbol_id ORDER BY c.start_line DESC, c.chunk_id) AS r
  FROM (SELECT DISTINCT ON (symbol_id) * FROM extracted_symbols) s JOIN {D.CHUNKS} c ON s.file_id = c.file_id AND s.start_line BETWEEN c.start_line AND c.end_line) WHERE r = 1)"""

SQL = {
    "text_document_terms": f"SELECT doc_id, term, tf FROM {D.postings('documents', 'doc_id')}",
    "text_identifier_parts": f"""WITH n AS (SELECT DISTINCT name FROM extracted_symbols), l AS (SELECT name, lower(name) AS t FROM n), p AS (SELECT name, {D.stem('t')} AS p FROM l), b AS (SELECT name, p, {_B} AS b FROM p)
SELECT name, array_to_string({D.split_identifier('name')}, ' ') AS parts, array_to_string({D.identifier_terms('name')}, ' ') AS terms, {_VERB.format(b='b', t='p')} AS verb_stem FROM b""",
    "text_question_terms": f"""WITH q AS (SELECT * FROM {D.QUESTIONS}), t AS (SELECT * FROM {D.question_terms('q', 'question_id', 'question')})
SELECT question_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS terms FROM q LEFT JOIN t USING (question_id) GROUP BY question_id""",
    "text_question_identifiers": f"""WITH q AS (SELECT * FROM {D.QUESTIONS}), t AS (SELECT * FROM {D.question_identifiers('q', 'question_id', 'question')})
SELECT question_id, coalesce(string_agg(name, ' ' ORDER BY name), '') AS identifiers FROM q LEFT JOIN t USING (question_id) GROUP BY question_id""",
    "text_path_terms": f"""WITH s AS (SELECT file_id, generate_subscripts(x, 1) AS a, unnest(x) AS seg FROM (SELECT file_id, string_split(path, '/') AS x FROM {D.FILES})),
p AS (SELECT file_id, a, generate_subscripts(y, 1) AS b, unnest(y) AS t FROM (SELECT file_id, a, {D.split_identifier("regexp_replace(seg, '[.][A-Za-z0-9]+$', '')")} AS y FROM s)),
d AS (SELECT file_id, term, min(a * 1000 + b) AS pos FROM (SELECT file_id, a, b, {D.stem('t')} AS term FROM p) WHERE length(term) >= 2 GROUP BY file_id, term)
SELECT f.file_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS terms FROM {D.FILES} f LEFT JOIN d USING (file_id) GROUP BY f.file_id""",
    "chunk_windows": f"""WITH f AS (SELECT file_id, {D.line_count('content')} AS n FROM {D.FILES}), w AS (SELECT file_id, n, unnest(range(1, n + 1, 50)) AS start_line FROM f)
SELECT file_id, start_line, least(n, start_line + 49) AS end_line FROM w""",
    "chunk_split_oversized": """WITH s AS (SELECT DISTINCT symbol_id, start_line, greatest(start_line, coalesce(end_line, start_line)) AS e FROM extracted_symbols), w AS (SELECT symbol_id, e, unnest(range(start_line, e + 1, 50)) AS start_line FROM s WHERE e - start_line + 1 > 80)
SELECT symbol_id, start_line, least(e, start_line + 49) AS end_line FROM w""",
    "chunk_merge_units": f"""WITH RECURSIVE f AS (SELECT file_id, {D.line_count('content')} AS n FROM {D.FILES}),
u0 AS (SELECT DISTINCT s.file_id, n, start_line AS a, least(greatest(start_line, coalesce(end_line, start_line)), n) AS b FROM extracted_symbols s JOIN f USING (file_id) WHERE parent IS NULL AND start_line <= n),
u AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY a, b) AS k FROM u0),
m AS (SELECT file_id, n, k, a, b, 1 AS g FROM u WHERE k = 1 UNION ALL
  SELECT u.file_id, u.n, u.k, CASE WHEN j THEN m.a ELSE u.a END, CASE WHEN j THEN greatest(m.b, u.b) ELSE u.b END, CASE WHEN j THEN m.g ELSE m.g + 1 END
  FROM m JOIN (SELECT * FROM u) u ON u.file_id = m.file_id AND u.k = m.k + 1, LATERAL (SELECT (m.b - m.a + 1 < 15 AND u.b - m.a + 1 <= 80) OR u.a <= m.b AS j)),
e0 AS (SELECT file_id, n, g, max(b) AS b FROM m GROUP BY file_id, n, g), e1 AS (SELECT *, max(g) OVER (PARTITION BY file_id) AS last FROM e0),
e AS (SELECT file_id, g, CASE WHEN g = last THEN n ELSE least(n, b) END AS e FROM e1),
c AS (SELECT file_id, e, coalesce(max(e) OVER (PARTITION BY file_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS s FROM e)
SELECT file_id, s AS start_line, e AS end_line FROM c WHERE e >= s""",
    "chunk_fingerprints": f"SELECT chunk_id, end_line, left(sha1(text), 12) AS chunk_hash, length(text) AS chars FROM {D.CHUNKS}",
    "index_vocabulary": f"WITH c AS (SELECT * FROM {D.CHUNKS}) SELECT repo, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM {D.postings('c', 'repo, chunk_id')} GROUP BY repo, term",
    "index_corpus_stats": f"""WITH c AS (SELECT * FROM {D.CHUNKS}), l AS (SELECT repo, chunk_id, sum(tf) AS n FROM {D.postings('c', 'repo, chunk_id')} GROUP BY repo, chunk_id)
SELECT repo, count(*) AS blocks, round(avg(coalesce(n, 0)), 6) AS mean_length FROM c LEFT JOIN l USING (repo, chunk_id) GROUP BY repo""",
    "text_permalinks": f"SELECT chunk_id, '/' || repo || '/blob/' || sha || '/' || array_to_string(list_transform(string_split(path, '/'), lambda s_: url_encode(s_)), '/') || '#L' || start_line || '-L' || end_line AS link FROM {D.CHUNKS}",
    "text_quote_verbatim": f"""WITH p AS (SELECT p.symbol_id, p.text, trim(regexp_replace(string_split(f.content, chr(10))[p.start_line], '{_WS}', ' ', 'g')) AS q FROM {PLACED} p JOIN {D.FILES} f USING (file_id))
SELECT symbol_id, {_TRIM} AS kept, length(q) >= 3 AND contains(trim(regexp_replace(text, '{_WS}', ' ', 'g')), q) AS verbatim FROM p""",
    "text_durations": "SELECT event_id, CAST(ceil(floor(value) * 60000 + (event_id % 60) * 1000 + 500) AS BIGINT) AS ms, true AS \"none\" FROM events",
}
