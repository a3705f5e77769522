"""Queries of extraction, entry questions, prompts, replies, reviews and request fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import requests as RQ
from quarrykit.operators import evaluation as V
from quarrykit.operators import extract as X
from quarrykit.operators import prompt as PR
from quarrykit.operators import questions as Q
from quarrykit.operators import validation as W
from quarrykit.plans import common as C
from quarrykit.plans import dialect as D
from quarrykit.plans.evaluation import _SCORES
from quarrykit.plans.graph import _ENTRIES
from quarrykit.plans.retrieval import LEXICAL, lexical_top
from quarrykit.session import stored, table


def _extracted(s, d):
    return X.extracted(table(s, d, "ingested_files"))


def _symbols(s, d):
    return X.symbol_rows(_extracted(s, d))


def _agreement(s, d):
    """Symbols of the given table, by kind, and how many of them the scan finds with the same name and first line."""
    given = table(s, d, "extracted_symbols").dropDuplicates(["symbol_id"]).select("file_id", "name", "start_line", "kind")
    found = _symbols(s, d).select("file_id", "name", "start_line", "kind", F.lit(True).alias("found")).distinct()
    return given.join(found, ["file_id", "name", "start_line", "kind"], "left").groupBy("kind").agg(F.count("*").alias("given"), F.count_if("found").alias("found"))


def _cover(s, d):
    """Every line of every file is in exactly one chunk of the scan."""
    e = _extracted(s, d)
    c = X.chunk_rows(e).groupBy("file_id").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("covered"), F.min("start_line").alias("first"), F.max("end_line").alias("last"))
    return e.where("language IN ('javascript', 'typescript', 'tsx') AND line_count > 0").select("file_id", "line_count").join(c, "file_id").select("file_id", "line_count", "covered", "first", "last")


def _packages(s, d):
    return Q.chosen_package(C.questions(s, d), C.declared_entries(s, d).where("entry_file_id IS NOT NULL").select("repo", F.when(F.col("package") == "", F.col("dir")).otherwise(F.col("package")).alias("package")))


def _manifests(s, d):
    f = C.sources(s, d).select("file_id", "repo", "sha", "path")
    return Q.nearest_manifest(f.select("repo", "sha", "path"), f).select("repo", "sha", "path", "manifest")


def _declaring(s, d):
    return Q.declaring_lines(C.sources(s, d).where(F.col("path").rlike(r"(^|/)package\.json\z")).select("file_id", "content"))


def _named(s, d):
    from quarrykit.functions import paths as P

    f = C.sources(s, d).where(P.file_class(F.col("path")) == "source").select("repo", "file_id", "path")
    w = C.sources(s, d).select("repo", F.col("file_id").alias("question_id"), F.split(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+\z", ""), r"[^a-z]+").alias("words"))
    w = w.withColumn("words", F.filter("words", lambda x: (F.length(x) >= 4) & ~x.endswith("s")))
    return Q.file_named(w, f)


def _evidence(s, d):
    top = stored(lexical_top(s, d).where("rank <= 5"))
    return top.join(C.texts(s, d, top), "chunk_id").withColumn("evidence_id", F.concat(F.lit("E"), F.col("rank").cast("string")))


def _prompts(s, d):
    e = F.struct("rank", "evidence_id", "path", "start_line", "end_line", "text")
    g = _evidence(s, d).groupBy("question_id").agg(F.array_sort(F.collect_list(e)).alias("evidence"))
    q = C.questions(s, d).select("question_id", "question", "repo").join(g, "question_id", "left")
    q = q.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<rank:int,evidence_id:string,path:string,start_line:int,end_line:int,text:string>>")))
    return PR.built(q.withColumn("sha", F.lit("0" * 40)).withColumn("notes", F.array(F.lit("one\nline"))))


def _read_back(s, d):
    r = PR.read_back(_prompts(s, d))
    return r.select("question_id", "evidence_id", "path", "start_line", "end_line", F.sha1("text").alias("text_sha1"))


def stand_in_replies(s, d):
    """Evidence of every question, and the parsed replies of the stand-in to it."""
    e = stored(_evidence(s, d).select("question_id", "evidence_id", F.col("rank").alias("place"), "path", "start_line", "end_line", "text"))
    return e, W.parsed(PR.stand_in(e).withColumnRenamed("question_id", "reply_id"))


def _answers(s, d):
    """The stand-in answers every question that has evidence; its replies go through the parser and the citation check."""
    e, replies = stand_in_replies(s, d)
    v = W.verdicts(replies, e.select(F.col("question_id").alias("reply_id"), "evidence_id", "text", F.lit(False).alias("suspect")))
    return W.answer_status(v).select(F.col("reply_id").alias("question_id"), "claims", "answer_status")


def _support(s, d):
    return table(s, d, "support").dropDuplicates(["support_id"])


def _reviews(s, d):
    sup = _support(s, d)
    items = sup.select(F.col("support_id").alias("id"), F.coalesce("label", F.lit("UNSUPPORTED")).alias("label"))
    human = sup.select(F.col("support_id").alias("id"), F.coalesce("fixture", F.lit(False)).alias("reviewed"), F.when(F.col("rationale").isNotNull(), F.lit("SUPPORTED")).alias("final_label"))
    older = sup.where(F.length("claim") % 2 == 0).select(F.col("support_id").alias("id"), F.lit("CONTRADICTED").alias("label"))
    return Q.reviewed_labels(items, human, older)


def _review_problems(s, d):
    sup = _support(s, d)
    reviews = table(s, d, "support").select(F.col("support_id").alias("id"), F.coalesce("fixture", F.lit(False)).alias("reviewed"), F.upper("label").alias("final_label"))
    return Q.review_problems(reviews, sup.where("rationale IS NOT NULL").select(F.col("support_id").alias("id")), list(PR.LABELS))


def _judged(s, d):
    raw = F.concat(F.lit('It is {"label": "'), F.col("label"), F.lit('", "reason": "as said"} so.'))
    return _support(s, d).select("support_id", PR.judged(F.coalesce(raw, F.lit("no"))).alias("label"))


def _affirmed(s, d):
    return _support(s, d).select("support_id", PR.affirmed(F.col("claim"), "touches|returns|logs").alias("affirmed"))


def _ranges(s, d):
    e = F.col("evidence")
    return _support(s, d).where("evidence IS NOT NULL").select("support_id", RQ.range_problem(e["path"], e["start_line"].cast("string"), (e["end_line"] + 380).cast("string")).alias("problem"))


def _searches(s, d):
    q = table(s, d, "questions").dropDuplicates(["question_id"])
    return q.select("question_id", RQ.search_problem(F.trim("repo"), F.sha1("question"), F.repeat("question", 3)).alias("problem"), RQ.short_quote(F.col("question")).alias("short"))


def _failures(s, d):
    top = stored(lexical_top(s, d))
    f = Q.failures(V.question_scores(C.questions(s, d), top), top)
    return f.select("question_id", "first_hit", F.coalesce(F.size("first_results"), F.lit(0)).alias("shown"))


def _changed(s, d):
    """First hits with three chunks of a file at most against one."""
    from quarrykit.operators import retrieval as R

    top = stored(lexical_top(s, d))
    one = R.capped_top_k(top.drop("rank"), "question_id", "file_id", "chunk_id", 1, 10)
    return Q.changed_ranks(V.question_scores(C.questions(s, d), top), V.question_scores(C.questions(s, d), one))


def _needs(s, d):
    """Expected places as needs, by category, met by the five best chunks."""
    e = V.expected_rows(C.questions(s, d)).join(C.questions(s, d).select("question_id", "category"), "question_id")
    needs = e.select(F.col("question_id").alias("case_id"), F.coalesce("category", F.lit("(none)")).alias("pattern"), F.col("item").alias("need_id"), F.col("expected_path").alias("path"),
                     F.coalesce("first_line", F.lit(1)).alias("first_line"), F.coalesce("last_line", F.lit(1_000_000)).alias("last_line"))
    ev = lexical_top(s, d).where("rank <= 5").select(F.col("question_id").alias("case_id"), "path", "start_line", "end_line")
    return Q.needs_met(needs, ev)


QUERIES = {
    "extract_symbols": _symbols,
    "extract_agreement": _agreement,
    "extract_cover": _cover,
    "extract_status": lambda s, d: X.status_counts(_extracted(s, d)),
    "entries_package": _packages,
    "entries_manifest": _manifests,
    "entries_declaring_lines": _declaring,
    "questions_file_named": _named,
    "prompts_read_back": _read_back,
    "answers_stand_in": _answers,
    "reviews_labels": _reviews,
    "reviews_problems": _review_problems,
    "replies_judged": _judged,
    "claims_affirmed": _affirmed,
    "requests_ranges": _ranges,
    "requests_searches": _searches,
    "eval_failures": _failures,
    "eval_changed_ranks": _changed,
    "eval_needs_met": _needs,
}

_ASKS_ENTRY = "(?i)(^|[^A-Za-z0-9_])(?:entry[\\s-]?(?:points?|files?|modules?)|package\\s+(?:exports?|entr(?:y|ies))|main\\s+(?:file|module|entry)|exports?\\s+(?:field|map))([^A-Za-z0-9_]|$)"
_SUP = "(SELECT DISTINCT ON (support_id) * FROM support)"
_COLS = ("'SUPPORTED'", "'PARTIALLY_SUPPORTED'", "'UNSUPPORTED'", "'CONTRADICTED'")
_STAND_IN = f"""{LEXICAL}, ev AS (SELECT question_id, rank, c.text, list_transform(string_split(c.text, chr(10)), lambda s_: trim(s_, ' ')) AS ls FROM top t JOIN c USING (chunk_id) WHERE rank <= 5),
qu AS (SELECT *, substr(coalesce(list_filter(ls, lambda x_: length(x_) >= 12 AND NOT regexp_matches(x_, '^(//|/?\\*|#)'))[1], list_filter(ls, lambda y_: length(y_) > 0)[1]), 1, 200) AS quote FROM ev WHERE rank <= 3), ok AS (SELECT * FROM qu WHERE length(quote) >= 3)"""
SQL = {
    "entries_package": f"""WITH {_ENTRIES}, p AS (SELECT DISTINCT repo, CASE WHEN package = '' THEN dir ELSE package END AS package FROM en WHERE entry_file_id IS NOT NULL), q AS (SELECT * FROM {D.QUESTIONS} WHERE regexp_matches(question, '{_ASKS_ENTRY}')),
j AS (SELECT question_id, package, package = string_split(q.repo, '/')[-1] AS own, len(list_filter(string_split(regexp_replace(' ' || lower(question) || ' ', '[^a-z0-9_@/.-]+', ' ', 'g'), ' '), lambda w_: regexp_replace(w_, '[.]+$', '') IN (lower(package), string_split(lower(package), '/')[-1]))) > 0 AS named FROM q JOIN p USING (repo)),
g AS (SELECT question_id, count(*) AS n, min(package) AS one, count(*) FILTER (named) AS names, min(package) FILTER (named) AS nm, min(package) FILTER (own) AS ow FROM j GROUP BY ALL)
SELECT * FROM (SELECT question_id, CASE WHEN n = 1 THEN one WHEN names = 1 THEN nm WHEN names = 0 THEN ow END AS package FROM g) WHERE package IS NOT NULL""",
    "questions_file_named": f"""WITH f0 AS (SELECT file_id, repo, path FROM {D.FILES}), f AS (SELECT * FROM f0 WHERE {D.file_class('path')} = 'source'),
w AS (SELECT repo, file_id AS question_id, list_filter(regexp_split_to_array(regexp_replace({D.base_name('path')}, '[.][^.]+$', ''), '[^a-z]+'), lambda x_: length(x_) >= 4 AND NOT ends_with(x_, 's')) AS words FROM f0),
t AS {D.path_terms('f', 'repo, file_id, path', 'path')}, x AS (SELECT repo, question_id, words[-1] AS last, len(list_distinct(words)) AS n, unnest(list_distinct(words)) AS term FROM w WHERE len(words) > 0),
h AS (SELECT question_id, file_id, path, last, n FROM x JOIN t USING (repo, term) GROUP BY ALL HAVING count(*) = n),
e AS (SELECT *, lower(regexp_replace({D.base_name('path')}, '[.][^.]+$', '')) = last OR (lower(regexp_replace({D.base_name('path')}, '[.][^.]+$', '')) = 'index' AND lower(string_split(path, '/')[-2]) = last) AS exact FROM h),
g AS (SELECT question_id, CASE WHEN count(*) = 1 THEN min(file_id) WHEN count(*) FILTER (exact) = 1 THEN min(file_id) FILTER (exact) END AS file_id FROM e GROUP BY question_id) SELECT * FROM g WHERE file_id IS NOT NULL""",
    "answers_stand_in": f"""WITH {_STAND_IN} SELECT question_id, count(*) AS claims, CASE WHEN bool_and(length(quote) >= 3 AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g')))) THEN 'answered' ELSE 'rejected' END AS answer_status FROM ok GROUP BY question_id""",
    "claims_affirmed": f"""WITH c AS (SELECT support_id, regexp_split_to_array(regexp_replace(claim, '(?i)(^|[^A-Za-z0-9_])(?:but|however|although|while)(?:[^A-Za-z0-9_]|$)', '\\1.', 'g'), '[.;:!?]') AS cs FROM {_SUP}),
m AS (SELECT support_id, list_filter(cs, lambda x_: regexp_matches(x_, '(?i)touches|returns|logs') AND NOT regexp_matches(right(regexp_extract(x_, '(?i)^([^.;:!?]*?)(?:touches|returns|logs)', 1), 60), '(?i)(^|[^A-Za-z0-9_])(?:not|never|no|cannot|without|nor|neither|none|lacks?|fails? to)([^A-Za-z0-9_]|$)|n[''’]t([^A-Za-z0-9_]|$)')) AS ok FROM c)
SELECT support_id, CASE WHEN ok IS NOT NULL THEN len(ok) > 0 END AS affirmed FROM m""",
    "eval_changed_ranks": f"""WITH {_SCORES}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY question_id, file_id ORDER BY score DESC, chunk_id) AS r1 FROM top) WHERE r1 <= 1) WHERE rk <= 10),
m1 AS (SELECT t.question_id, min(t.rk) AS first_hit FROM one t JOIN e USING (question_id) WHERE t.path = x.path AND (x.lines[1] IS NULL OR (t.start_line <= x.lines[2] AND t.end_line >= x.lines[1])) GROUP BY ALL)
SELECT question_id, sc.first_hit AS before, m1.first_hit AS after FROM sc LEFT JOIN m1 USING (question_id) WHERE NOT negative AND sc.first_hit IS DISTINCT FROM m1.first_hit""",
    "extract_cover": _cover,
    "extract_status": lambda s, d: X.status_counts(_extracted(s, d)),
    "entries_package": _packages,
    "entries_manifest": _manifests,
    "entries_declaring_lines": _declaring,
    "questions_file_named": _named,
    "prompts_read_back": _read_back,
    "answers_stand_in": _answers,
    "reviews_labels": _reviews,
    "reviews_problems": _review_problems,
    "replies_judged": _judged,
    "claims_affirmed": _affirmed,
    "requests_ranges": _ranges,
    "requests_searches": _searches,
    "eval_failures": _failures,
    "eval_changed_ranks": _changed,
    "eval_needs_met": _needs,
}

_ASKS_ENTRY = "(?i)(^|[^A-Za-z0-9_])(?:entry[\\s-]?(?:points?|files?|modules?)|package\\s+(?:exports?|entr(?:y|ies))|main\\s+(?:file|module|entry)|exports?\\s+(?:field|map))([^A-Za-z0-9_]|$)"
_SUP = "(SELECT DISTINCT ON (support_id) * FROM support)"
_COLS = ("'SUPPORTED'", "'PARTIALLY_SUPPORTED'", "'UNSUPPORTED'", "'CONTRADICTED'")
_STAND_IN = f"""{LEXICAL}, ev AS (SELECT question_id, rank, c.text, list_transform(string_split(c.text, chr(10)), lambda s_: trim(s_, ' ')) AS ls FROM top t JOIN c USING (chunk_id) WHERE rank <= 5),
qu AS (SELECT *, substr(coalesce(list_filter(ls, lambda x_: length(x_) >= 12 AND NOT regexp_matches(x_, '^(//|/?\\*|#)'))[1], list_filter(ls, lambda y_: length(y_) > 0)[1]), 1, 200) AS quote FROM ev WHERE rank <= 3), ok AS (SELECT * FROM qu WHERE length(quote) >= 3)"""
SQL = {
    "entries_package": f"""WITH {_ENTRIES}, p AS (SELECT DISTINCT repo, CASE WHEN package = '' THEN dir ELSE package END AS package FROM en WHERE entry_file_id IS NOT NULL), q AS (SELECT * FROM {D.QUESTIONS} WHERE regexp_matches(question, '{_ASKS_ENTRY}')),
j AS (SELECT question_id, package, package = string_split(q.repo, '/')[-1] AS own, len(list_filter(string_split(regexp_replace(' ' || lower(question) || ' ', '[^a-z0-9_@/.-]+', ' ', 'g'), ' '), lambda w_: regexp_replace(w_, '[.]+$', '') IN (lower(package), string_split(lower(package), '/')[-1]))) > 0 AS named FROM q JOIN p USING (repo)),
g AS (SELECT question_id, count(*) AS n, min(package) AS one, count(*) FILTER (named) AS names, min(package) FILTER (named) AS nm, min(package) FILTER (own) AS ow FROM j GROUP BY ALL)
SELECT * FROM (SELECT question_id, CASE WHEN n = 1 THEN one WHEN names = 1 THEN nm WHEN names = 0 THEN ow END AS package FROM g) WHERE package IS NOT NULL""",
    "questions_file_named": f"""WITH f0 AS (SELECT file_id, repo, path FROM {D.FILES}), f AS (SELECT * FROM f0 WHERE {D.file_class('path')} = 'source'),
w AS (SELECT repo, file_id AS question_id, list_filter(regexp_split_to_array(regexp_replace({D.base_name('path')}, '[.][^.]+$', ''), '[^a-z]+'), lambda x_: length(x_) >= 4 AND NOT ends_with(x_, 's')) AS words FROM f0),
t AS {D.path_terms('f', 'repo, file_id, path', 'path')}, x AS (SELECT repo, question_id, words[-1] AS last, len(list_distinct(words)) AS n, unnest(list_distinct(words)) AS term FROM w WHERE len(words) > 0),
h AS (SELECT question_id, file_id, path, last, n FROM x JOIN t USING (repo, term) GROUP BY ALL HAVING count(*) = n),
e AS (SELECT *, lower(regexp_replace({D.base_name('path')}, '[.][^.]+$', '')) = last OR (lower(regexp_replace({D.base_name('path')}, '[.][^.]+$', '')) = 'index' AND lower(string_split(path, '/')[-2]) = last) AS exact FROM h),
g AS (SELECT question_id, CASE WHEN count(*) = 1 THEN min(file_id) WHEN count(*) FILTER (exact) = 1 THEN min(file_id) FILTER (exact) END AS file_id FROM e GROUP BY question_id) SELECT * FROM g WHERE file_id IS NOT NULL""",
    "answers_stand_in": f"""WITH {_STAND_IN} SELECT question_id, count(*) AS claims, CASE WHEN bool_and(length(quote) >= 3 AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g')))) THEN 'answered' ELSE 'rejected' END AS answer_status FROM ok GROUP BY question_id""",
    "claims_affirmed": f"""WITH c AS (SELECT support_id, regexp_split_to_array(regexp_replace(claim, '(?i)(^|[^A-Za-z0-9_])(?:but|however|although|while)(?:[^A-Za-z0-9_]|$)', '\\1.', 'g'), '[.;:!?]') AS cs FROM {_SUP}),
m AS (SELECT support_id, list_filter(cs, lambda x_: regexp_matches(x_, '(?i)touches|returns|logs') AND NOT regexp_matches(right(regexp_extract(x_, '(?i)^([^.;:!?]*?)(?:touches|returns|logs)', 1), 60), '(?i)(^|[^A-Za-z0-9_])(?:not|never|no|cannot|without|nor|neither|none|lacks?|fails? to)([^A-Za-z0-9_]|$)|n[''’]t([^A-Za-z0-9_]|$)')) AS ok FROM c)
SELECT support_id, CASE WHEN ok IS NOT NULL THEN len(ok) > 0 END AS affirmed FROM m""",
    "eval_changed_ranks": f"""WITH {_SCORES}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY question_id, file_id ORDER BY score DESC, chunk_id) AS r1 FROM top) WHERE r1 <= 1) WHERE rk <= 10),
m1 AS (SELECT t.question_id, min(t.rk) AS first_hit FROM one t JOIN e USING (question_id) WHERE t.path = x.path AND (x.lines[1] IS NULL OR (t.start_line <= x.lines[2] AND t.end_line >= x.lines[1])) GROUP BY ALL)
SELECT question_id, sc.first_hit AS before, m1.first_hit AS after FROM sc LEFT JOIN m1 USING (question_id) WHERE NOT negative AND sc.first_hit IS DISTINCT FROM m1.first_hit""",
    "eval_needs_met": f"""WITH {_SCORES}, nn AS (SELECT question_id, coalesce(category, '(none)') AS pattern, item, x.path AS path, coalesce(x.lines[1], 1) AS a, coalesce(x.lines[2], 1000000) AS b FROM e JOIN q USING (question_id)),
nk AS (SELECT nn.*, EXISTS (SELECT 1 FROM top t WHERE t.question_id = nn.question_id AND rank <= 5 AND t.path = nn.path AND t.start_line <= nn.b AND t.end_line >= nn.a) AS met FROM nn),
nc AS (SELECT pattern, question_id, count(*) AS needs, count(*) FILTER (met) AS met, bool_and(met) AS whole FROM nk GROUP BY ALL) SELECT pattern, count(*) AS cases, CAST(sum(needs) AS BIGINT) AS needs, CAST(sum(met) AS BIGINT) AS met, count(*) FILTER (whole) AS "full" FROM nc GROUP BY pattern""",
    "extract_cover": f"SELECT file_id, n AS line_count, n AS covered, 1 AS first, n AS last FROM (SELECT file_id, path, {D.line_count('c')} AS n FROM (SELECT file_id, path, ltrim(content, chr(65279)) AS c FROM {D.FILES})) WHERE {D.language_of('path')} IN ('javascript', 'typescript', 'tsx') AND n > 0",
    "entries_manifest": f"""WITH f AS (SELECT repo, sha, path FROM {D.FILES}), k AS (SELECT repo, sha, path, unnest(range(0, len(string_split(path, '/')))) AS depth FROM f), m AS (SELECT *, array_to_string(list_append(string_split(path, '/')[1:depth], 'package.json'), '/') AS manifest FROM k)
SELECT m.repo, m.sha, m.path, arg_max(m.manifest, depth) AS manifest FROM m JOIN f ON f.repo = m.repo AND f.sha = m.sha AND f.path = m.manifest GROUP BY ALL""",
    "entries_declaring_lines": f"""WITH r AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {D.FILES} WHERE regexp_matches(path, '(^|/)package\\.json$'))
SELECT file_id, min(line) AS line FROM r WHERE regexp_matches(text, '^\\s*"(?:main|module|exports|bin|browser|types)"\\s*:') GROUP BY file_id""",
    "prompts_read_back": f"WITH {LEXICAL} SELECT question_id, 'E' || rank AS evidence_id, t.path, t.start_line, t.end_line, sha1(c.text) AS text_sha1 FROM top t JOIN c USING (chunk_id) WHERE rank <= 5",
    "reviews_labels": f"""WITH s AS (SELECT support_id AS id, coalesce(label, 'UNSUPPORTED') AS draft, CASE WHEN coalesce(fixture, false) AND rationale IS NOT NULL THEN 'SUPPORTED' END AS h, CASE WHEN length(claim) % 2 = 0 THEN 'CONTRADICTED' END AS o FROM {_SUP})
SELECT id, coalesce(h, o, draft) AS label, draft AS draft_label, CASE WHEN h IS NOT NULL THEN 'human' WHEN o IS NOT NULL THEN 'older' ELSE 'draft' END AS label_source FROM s""",
    "reviews_problems": f"""WITH r AS (SELECT support_id AS id, coalesce(fixture, false) AS reviewed, upper(label) AS l FROM support), i AS (SELECT support_id AS id FROM {_SUP} WHERE rationale IS NOT NULL)
SELECT id, 'duplicate' AS problem FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'unknown' FROM r WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT id, 'missing' FROM i WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT DISTINCT id, 'bad-label' FROM r WHERE NOT coalesce(CASE WHEN reviewed THEN l IN ({', '.join(_COLS)}) ELSE l IS NULL END, false)""",
    "replies_judged": f"SELECT support_id, CASE WHEN label IN ({', '.join(_COLS)}) THEN label END AS label FROM {_SUP}",
    "requests_ranges": f"""SELECT support_id, CASE WHEN evidence.path IS NULL OR evidence.path = '' OR evidence.start_line IS NULL OR evidence.end_line IS NULL THEN 'missing' WHEN evidence.start_line < 1 THEN 'not a line number' WHEN evidence.end_line + 380 < evidence.start_line THEN 'reversed'
WHEN evidence.end_line + 380 - evidence.start_line + 1 > 400 THEN 'too many lines' END AS problem FROM {_SUP} WHERE evidence IS NOT NULL""",
    "requests_searches": """SELECT question_id, CASE WHEN repo IS NULL OR question IS NULL OR trim(repo) = '' OR question = '' THEN 'missing' WHEN length(question) * 3 > 300 THEN 'question too long'
WHEN NOT regexp_matches(trim(repo), '^[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]{1,100}$') THEN 'not a repository' END AS problem, length(regexp_replace(question, '\\s+', '', 'g')) < 20 AS short FROM (SELECT DISTINCT ON (question_id) * FROM questions)""",
    "eval_failures": f"WITH {_SCORES} SELECT question_id, first_hit, coalesce((SELECT count(*) FROM top t WHERE t.question_id = sc.question_id AND rank <= 4), 0) AS shown FROM sc WHERE NOT negative AND NOT hit5",
}
