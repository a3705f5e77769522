"""Queries of scanning, filtering and classifying files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrykit.functions import paths as P
from quarrykit.operators import evaluation as V
from quarrykit.operators import state as S
from quarrykit.plans import common as C
from quarrykit.plans import dialect as D
from quarrykit.session import table


def _paths(s, d):
    p = F.col("path")
    return C.sources(s, d).select(
        "file_id", P.extension_of(p).alias("extension"), P.language_of(p).alias("language"), P.skip_reason(p).alias("skip_reason"), P.file_class(p).alias("file_class"),
    )


def _content(s, d):
    f = C.sources(s, d)
    return f.select("file_id", P.content_skip_reason(F.col("content"), P.language_of(F.col("path"))).alias("skip_reason"))


def _archive_paths(s, d):
    """Paths as an archive would give them, good and bad: below a root folder, absolute, climbing, with a backslash."""
    f = C.sources(s, d).select("file_id", "path")
    raw = F.explode(
        F.array(
            F.concat(F.lit("root-1/./"), "path"), F.concat(F.lit("/"), "path"), F.concat(F.lit("root-1/../"), "path"), F.replace(F.concat(F.lit("root-1/"), "path"), F.lit("/"), F.lit("\\")),
            F.concat(F.lit("C:"), "path"), F.repeat(F.concat("path", F.lit("/")), 30), F.lit(""), F.lit("./"), F.col("path"),
        )
    )
    r = f.select("file_id", raw.alias("raw")).distinct()
    return r.select("file_id", "raw", P.archive_path_reason(F.col("raw")).alias("reason"), P.archive_path(F.col("raw")).alias("path"), P.strip_root(F.col("raw")).alias("below_root"))


def _keys(s, d):
    r = table(s, d, "repos").select("repo", "sha").distinct()
    k = P.index_key(F.col("repo"), F.col("sha"))
    typed = F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit(".git"))
    return r.select(k.alias("key"), P.key_parts(k)["owner"].alias("owner"), P.key_parts(k)["sha"].alias("sha"), P.is_repo_ref(F.col("repo")).alias("good_ref"), P.is_sha(F.col("sha")).alias("good_sha"), P.repo_of_input(typed).alias("parsed"))


def _ingest_stats(s, d):
    """Skipped entries of every repository by reason, as its builds report them."""
    b = table(s, d, "built_indexes").dropDuplicates(["build_id"])
    return b.select("repo", F.explode("skipped").alias("reason", "n")).groupBy("repo", "reason").agg(F.sum("n").alias("entries"), F.count("*").alias("builds"))


def _rejected(s, d):
    b = table(s, d, "built_indexes").dropDuplicates(["build_id"])
    return b.select(F.explode("rejected_paths").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("entries"))


def _parse_status(s, d):
    b = table(s, d, "built_indexes").dropDuplicates(["build_id"])
    x = b.select("repo", F.explode("parse_status").alias("language", "by")).select("repo", "language", F.explode("by").alias("status", "n"))
    return x.groupBy("repo", "language").pivot("status", ["ast", "ast-with-errors", "fallback", "text"]).agg(F.sum("n")).fillna(0)


def _fallbacks(s, d):
    b = table(s, d, "built_indexes").dropDuplicates(["build_id"])
    return b.select(F.explode("parse_fallback_reasons").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("files"))


def _summary(s, d):
    f = C.sources(s, d)
    files = f.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"), F.countDistinct("sha").alias("commits"))
    ch = table(s, d, "extracted_chunks").dropDuplicates(["chunk_id"]).groupBy("repo").agg(F.count("*").alias("chunks"))
    sy = table(s, d, "extracted_symbols").dropDuplicates(["symbol_id"]).groupBy("repo").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))
    return files.join(ch, "repo", "left").join(sy, "repo", "left").fillna(0, ["chunks", "symbols", "exported"])


def _languages(s, d):
    f = C.sources(s, d).select("repo", P.language_of(F.col("path")).alias("language"), P.file_class(F.col("path")).alias("file_class"))
    return f.cube("language", "file_class").agg(F.count("*").alias("files"), F.grouping_id().alias("level"))


def _retention(s, d):
    b = table(s, d, "built_indexes").dropDuplicates(["build_id"]).select("build_id", "repo", "built_at", "delivered_bytes")
    return S.retained(b, ["repo"], [F.desc("built_at"), F.desc("build_id")], "delivered_bytes", 250_000).select("build_id", "repo", "delivered_bytes")


def _sizes(s, d):
    f = C.sources(s, d).select("repo", F.length("content").alias("chars"))
    p = V.floor_percentiles(f, ["repo"], "chars", 0.95).withColumnRenamed("percentile", "p95")
    return f.groupBy("repo").agg(F.median("chars").alias("median"), F.max("chars").alias("most")).join(p, "repo")


def _late(s, d):
    """Files that arrived more than an hour after their build, for each build."""
    f = table(s, d, "ingested_files").dropDuplicates(["file_id"]).select("build_id", "ingested_at")
    b = table(s, d, "built_indexes").dropDuplicates(["build_id"]).select("build_id", "built_at")
    j = f.join(b, "build_id")
    return j.groupBy("build_id").agg(F.count("*").alias("files"), F.count_if(F.col("ingested_at") > F.col("built_at") + F.expr("INTERVAL 1 HOUR")).alias("late"), F.count_if(F.col("ingested_at").isNull()).alias("unknown"))


def _recent(s, d):
    q = C.questions(s, d)
    one = Window.partitionBy("repo", "question").orderBy(F.desc_nulls_last("added_at"), F.desc("question_id"))
    w = Window.partitionBy("repo").orderBy(F.desc_nulls_last("added_at"), F.desc("question_id"))
    return q.withColumn("r", F.row_number().over(one)).where("r = 1").withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("repo", "question_id", "rank")


def _missing(s, d):
    """Expected places whose path is not in the repository, or whose lines end past the file, and terms said to be absent that its index holds."""
    e = V.expected_rows(C.questions(s, d)).join(C.questions(s, d).select("question_id", "repo"), "question_id")
    from quarrykit.functions import text as T

    f = C.sources(s, d).groupBy("repo", F.col("path").alias("expected_path")).agg(F.max(T.line_count(F.col("content"))).alias("lines"))
    j = e.join(f, ["repo", "expected_path"], "left")
    bad = F.when(F.col("lines").isNull(), "no-such-file").when(F.col("last_line") > F.col("lines"), "past-the-end")
    places = j.select("question_id", "item", bad.alias("problem")).where("problem IS NOT NULL")
    a = C.questions(s, d).select("question_id", "repo", F.posexplode("absent_terms").alias("item", "word")).select("question_id", "repo", "item", T.stem(F.lower("word")).alias("term"))
    held = a.join(C.index_table(s, d, "frequencies").select("repo", "term"), ["repo", "term"], "left_semi")
    return places.unionByName(held.select("question_id", "item", F.lit("absent-term-present").alias("problem")))


QUERIES = {
    "files_paths": _paths,
    "files_content": _content,
    "files_archive_paths": _archive_paths,
    "files_keys": _keys,
    "ingest_skipped": _ingest_stats,
    "ingest_rejected": _rejected,
    "ingest_parse_status": _parse_status,
    "ingest_fallbacks": _fallbacks,
    "ingest_late_files": _late,
    "repo_summary": _summary,
    "repo_languages": _languages,
    "store_retention": _retention,
    "files_size_quantiles": _sizes,
    "questions_recent": _recent,
    "dataset_integrity": _missing,
}

_SEG = "list_filter(string_split(raw, '/'), lambda s_: s_ NOT IN ('', '.'))"
SQL = {
    "files_paths": f"SELECT file_id, {D.extension_of('path')} AS extension, {D.language_of('path')} AS language, {D.skip_reason('path')} AS skip_reason, {D.file_class('path')} AS file_class FROM {D.FILES}",
    "files_content": f"""WITH p AS (SELECT file_id, path, content, left(content, 200000) AS probe FROM {D.FILES})
SELECT file_id, CASE WHEN contains(left(content, 8000), chr(0)) THEN 'binary-content' WHEN regexp_matches(left(content, 600), '(?i)@generated|DO NOT EDIT|auto-?generated|This file (was|is) generated') THEN 'generated'
WHEN {D.language_of('path')} <> 'markdown' AND length(probe) / (length(probe) - length(replace(probe, chr(10), '')) + 1) > 200 THEN 'minified-content' END AS skip_reason FROM p""",
    "files_archive_paths": f"""WITH r AS (SELECT DISTINCT file_id, unnest(['root-1/./' || path, '/' || path, 'root-1/../' || path, replace('root-1/' || path, '/', '\\'), 'C:' || path, repeat(path || '/', 30), '', './', path]) AS raw FROM {D.FILES}),
w AS (SELECT file_id, raw, CASE WHEN raw = '' THEN 'empty' WHEN length(raw) > 400 THEN 'too-long' WHEN contains(raw, '\\') THEN 'backslash' WHEN starts_with(raw, '/') OR regexp_matches(raw, '^[A-Za-z]:') THEN 'absolute'
  WHEN list_contains(string_split(raw, '/'), '..') OR len({_SEG}) = 0 THEN 'traversal' END AS reason FROM r)
SELECT file_id, raw, reason, CASE WHEN reason IS NULL THEN array_to_string({_SEG}, '/') END AS path, CASE WHEN contains(raw, '/') THEN substr(raw, instr(raw, '/') + 1) END AS below_root FROM w""",
    "files_keys": """SELECT DISTINCT repo || '@' || sha AS "key", split_part(repo, '/', 1) AS owner, sha, regexp_matches(repo, '^[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]{1,100}$') AS good_ref, regexp_matches(sha, '^[0-9a-f]{40}$') AS good_sha, repo AS parsed FROM repos""",
    "ingest_skipped": """WITH b AS (SELECT DISTINCT ON (build_id) * FROM built_indexes), e AS (SELECT repo, unnest(map_entries(skipped)) AS e FROM b)
SELECT repo, e.key AS reason, CAST(sum(e.value) AS BIGINT) AS entries, count(*) AS builds FROM e GROUP BY repo, e.key""",
    "ingest_rejected": "WITH b AS (SELECT DISTINCT ON (build_id) * FROM built_indexes), e AS (SELECT unnest(map_entries(rejected_paths)) AS e FROM b) SELECT e.key AS reason, CAST(sum(e.value) AS BIGINT) AS entries FROM e GROUP BY e.key",
    "ingest_parse_status": """WITH b AS (SELECT DISTINCT ON (build_id) * FROM built_indexes), e AS (SELECT repo, unnest(map_entries(parse_status)) AS e FROM b), x AS (SELECT repo, e.key AS language, unnest(map_entries(e.value)) AS s FROM e)
SELECT repo, language, CAST(coalesce(sum(s.value) FILTER (s.key = 'ast'), 0) AS BIGINT) AS ast, CAST(coalesce(sum(s.value) FILTER (s.key = 'ast-with-errors'), 0) AS BIGINT) AS "ast-with-errors", CAST(coalesce(sum(s.value) FILTER (s.key = 'fallback'), 0) AS BIGINT) AS fallback, CAST(coalesce(sum(s.value) FILTER (s.key = 'text'), 0) AS BIGINT) AS text FROM x GROUP BY repo, language""",
    "ingest_fallbacks": "WITH b AS (SELECT DISTINCT ON (build_id) * FROM built_indexes), e AS (SELECT unnest(map_entries(parse_fallback_reasons)) AS e FROM b) SELECT e.key AS reason, CAST(sum(e.value) AS BIGINT) AS files FROM e GROUP BY e.key",
    "ingest_late_files": """WITH f AS (SELECT DISTINCT ON (file_id) build_id, ingested_at FROM ingested_files), b AS (SELECT DISTINCT ON (build_id) build_id, built_at FROM built_indexes)
SELECT build_id, count(*) AS files, count(*) FILTER (ingested_at > built_at + INTERVAL 1 HOUR) AS late, count(*) FILTER (ingested_at IS NULL) AS unknown FROM f JOIN b USING (build_id) GROUP BY build_id""",
    "repo_summary": f"""WITH f AS (SELECT repo, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT sha) AS commits FROM {D.FILES} GROUP BY repo),
c AS (SELECT repo, count(DISTINCT chunk_id) AS chunks FROM extracted_chunks GROUP BY repo), s AS (SELECT repo, count(DISTINCT symbol_id) AS symbols, count(DISTINCT symbol_id) FILTER (exported) AS exported FROM extracted_symbols GROUP BY repo)
SELECT repo, files, chars, commits, coalesce(chunks, 0) AS chunks, coalesce(symbols, 0) AS symbols, coalesce(exported, 0) AS exported FROM f LEFT JOIN c USING (repo) LEFT JOIN s USING (repo)""",
    "repo_languages": f"WITH f AS (SELECT {D.language_of('path')} AS language, {D.file_class('path')} AS file_class FROM {D.FILES}) SELECT language, file_class, count(*) AS files, grouping(language, file_class) AS level FROM f GROUP BY CUBE (language, file_class)",
    "store_retention": """WITH b AS (SELECT DISTINCT ON (build_id) build_id, repo, built_at, delivered_bytes FROM built_indexes), w AS (SELECT *, row_number() OVER o AS r, sum(delivered_bytes) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM b WINDOW o AS (PARTITION BY repo ORDER BY built_at DESC, build_id DESC))
SELECT build_id, repo, delivered_bytes FROM w WHERE t <= 250000 OR r = 1""",
    "files_size_quantiles": f"""WITH f AS (SELECT repo, length(content) AS chars FROM {D.FILES}) SELECT repo, median(chars) AS median, max(chars) AS most, list_sort(list(chars))[1 + least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS p95 FROM f GROUP BY repo""",
    "questions_recent": f"""WITH q AS (SELECT * FROM {D.QUESTIONS}), o AS (SELECT *, row_number() OVER (PARTITION BY repo, question ORDER BY added_at DESC NULLS LAST, question_id DESC) AS r FROM q)
SELECT repo, question_id, rank FROM (SELECT repo, question_id, row_number() OVER (PARTITION BY repo ORDER BY added_at DESC NULLS LAST, question_id DESC) AS rank FROM o WHERE r = 1) WHERE rank <= 6""",
    "dataset_integrity": f"""WITH e AS (SELECT question_id, repo, generate_subscripts(expected, 1) - 1 AS item, unnest(expected) AS x FROM {D.QUESTIONS}), f AS (SELECT repo, path, max({D.line_count('content')}) AS lines FROM {D.FILES} GROUP BY repo, path)
SELECT question_id, item, CASE WHEN lines IS NULL THEN 'no-such-file' ELSE 'past-the-end' END AS problem FROM e LEFT JOIN f ON e.repo = f.repo AND x.path = f.path WHERE lines IS NULL OR x.lines[2] > lines
UNION ALL SELECT question_id, item, 'absent-term-present' FROM (SELECT question_id, repo, item, {D.stem('w')} AS term FROM (SELECT question_id, repo, generate_subscripts(absent_terms, 1) - 1 AS item, lower(unnest(absent_terms)) AS w FROM {D.QUESTIONS})) a
  WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT repo, term FROM {D.postings(D.CHUNKS, 'repo, chunk_id')}) v WHERE v.repo = a.repo AND v.term = a.term)""",
}
