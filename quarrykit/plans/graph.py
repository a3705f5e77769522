"""Queries of imports, entries, definitions and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.config import BUILTINS
from quarrykit.functions import paths as P
from quarrykit.functions import text as T
from quarrykit.operators import evidence as E
from quarrykit.operators import imports as M
from quarrykit.operators import validation as X
from quarrykit.plans import common as C
from quarrykit.plans import dialect as D
from quarrykit.plans.retrieval import LEXICAL, lexical_top
from quarrykit.session import stored, table


def _imports(s, d):
    return M.import_rows(table(s, d, "ingested_files")).groupBy("file_id", "line", "specifier", "kind").agg(F.count("*").alias("n"))


def _exports(s, d):
    return M.export_rows(table(s, d, "ingested_files")).select("file_id", "name", "line")


def _categories(s, d):
    return M.category_counts(C.resolved_imports(s, d))


def _aliases(s, d):
    """What every bare specifier but the built-in modules stands for, seen from a folder."""
    r = C.resolved_imports(s, d).where(~F.col("specifier").startswith(".") & (F.col("resolution") != "bare:node-builtin"))
    return r.select("repo", "sha", M.directory(F.col("path")).alias("folder"), "specifier", "target_file_id", "resolution").distinct()


def _relative(s, d):
    r = F.col("resolution")
    return C.resolved_imports(s, d).agg(F.count_if(r.startswith("relative:")).alias("relative_total"), F.count_if(r == "relative:resolved").alias("relative_resolved"), F.count("*").alias("imports"))


def _hops(s, d):
    """Files one hop away over resolved imports, in both directions."""
    e = C.index_table(s, d, "edges").select("file_id", F.col("target_file_id").alias("near")).distinct()
    return e.unionByName(e.select(F.col("near").alias("file_id"), F.col("file_id").alias("near"))).distinct()


def _entry_stats(s, d):
    return M.entry_stats(C.declared_entries(s, d))


def _entries(s, d):
    return C.declared_entries(s, d).select("file_id", "dir", "package", "entry_kind", "target", "entry_file_id")


def _importers(s, d):
    return E.importers(C.questions(s, d), C.resolved_imports(s, d), C.file_rows(s, d)).select("question_id", "file_id", "line", "rank")


def _asked(s, d):
    return C.questions(s, d).select("question_id", F.regexp_replace(E.imported_name(F.col("question")), "[`\"']", "").alias("name")).where("name IS NOT NULL")


def _calls(s, d):
    return E.calls(C.chunks(s, d), ["chunk_id"]).groupBy("chunk_id", "name").agg(F.count("*").alias("calls"))


def _definitions(s, d):
    from quarrykit.operators import index as I

    src = I.files(table(s, d, "ingested_files")).where("file_class = 'source'").select("file_id")
    sym = C.symbols(s, d).where(F.col("kind").isin("function", "method", "variable") & (F.col("end_line") > F.col("start_line"))).join(src, "file_id", "left_semi")
    called = E.calls(C.chunks(s, d), ["repo", "file_id"]).select("repo", "file_id", "name").distinct()
    return E.called_definitions(called, sym, C.index_table(s, d, "edges")).select("from_file", "name", "symbol_id")


def _best_overlap(s, d):
    return E.best_overlap(C.symbols(s, d), C.index_table(s, d, "chunks")).select("symbol_id", "chunk_id", "overlap")


def _support_lines(s, d):
    sup = table(s, d, "support").dropDuplicates(["support_id"]).where("evidence IS NOT NULL")
    x = sup.select(C.repo_key(F.col("repo")).alias("repo"), F.col("evidence.path").alias("path"), F.col("evidence.start_line").alias("line"))
    return x.join(C.sources(s, d).select("file_id", "repo", "path"), ["repo", "path"]).select("file_id", "line").distinct()


def _enclosing(s, d):
    return E.enclosing_symbol(_support_lines(s, d), C.symbols(s, d))


def _verified(s, d):
    """The best chunks of every question, read again from source; a chunk is tampered with where its end was cut."""
    whole = table(s, d, "extracted_chunks").dropDuplicates(["chunk_id"]).select("chunk_id", F.coalesce("end_line", F.lit(-1)).alias("stored_end"))
    top = lexical_top(s, d).join(C.index_table(s, d, "chunks").select("chunk_id", "chunk_hash"), "chunk_id").join(whole, "chunk_id")
    top = top.withColumn("end_line", F.when(F.col("stored_end") < 0, F.col("end_line") - 1).otherwise(F.col("stored_end")))
    top = stored(top.select("question_id", "rank", "chunk_id", "file_id", "start_line", "end_line", "chunk_hash"))
    src = table(s, d, "ingested_files").select("file_id", F.coalesce("content", F.lit("")).alias("content"))
    return top.select("question_id", "rank", "chunk_id").join(E.verdicts(top, src), "chunk_id").select("question_id", "rank", "chunk_id", "reason", "suspect")


def _admitted(s, d):
    top = lexical_top(s, d).join(C.index_table(s, d, "chunks").select("chunk_id", "chars"), "chunk_id").select("question_id", "rank", "chunk_id", "chars")
    return E.admit(top, "question_id", ["rank"], "chars", 8, 6_000).select("question_id", "evidence_id", "chunk_id", "chars")


def _not_shown(s, d):
    """Symbols' first chunks of a file that overlap none of the lines a claim's evidence shows."""
    sup = table(s, d, "support").dropDuplicates(["support_id"]).where("evidence IS NOT NULL")
    shown = sup.select(C.repo_key(F.col("repo")).alias("repo"), F.col("evidence.path").alias("path"), F.col("evidence.start_line").alias("start_line"), F.col("evidence.end_line").alias("end_line"))
    shown = shown.join(C.sources(s, d).select("file_id", "repo", "path"), ["repo", "path"]).select("file_id", "start_line", "end_line")
    ch = C.index_table(s, d, "chunks").join(shown.select("file_id").distinct(), "file_id", "left_semi").select("chunk_id", "file_id", "start_line", "end_line")
    return E.not_shown(ch, shown, ["file_id"]).select("chunk_id", "file_id")


def _locators(s, d):
    """Evidence of claims as citations against the files they name: the first reason each fails for."""
    sup = table(s, d, "support").dropDuplicates(["support_id"])
    loc = sup.select(
        F.col("support_id").alias("reply_id"), F.lit("E1").alias("evidence_id"), F.lit(None).cast("string").alias("owner"), C.repo_key(F.col("repo")).alias("repo"), F.lit(None).cast("string").alias("sha"),
        F.col("evidence.path").alias("path"), F.col("evidence.start_line").alias("start_line"), F.col("evidence.end_line").alias("end_line"),
    )
    src = C.sources(s, d).select("repo", "path", "sha", T.line_count(F.col("content")).alias("file_lines"))
    reg = loc.select("reply_id", "evidence_id", "repo", "path").join(src, ["repo", "path"]).select(
        "reply_id", "evidence_id", F.lit("o").alias("owner"), "repo", "sha", "path", F.lit(1).alias("start_line"), F.least("file_lines", F.lit(80)).alias("end_line"), "file_lines",
        F.lit("o").alias("want_owner"), F.col("repo").alias("want_repo"), F.col("sha").alias("want_sha"), F.struct("sha", "file_lines").alias("pos"),
    )
    return X.check_locators(loc, reg).select(F.col("reply_id").alias("support_id"), "reason")


def _replies(s, d):
    """Replies built from claims, some of them malformed, and what the strict parser says of each."""
    sup = table(s, d, "support").dropDuplicates(["support_id"]).select("support_id", "claim", "label")
    claim = F.struct(F.col("claim").alias("text"), F.array(F.struct(F.lit("E1").alias("citation"), F.substring("claim", 1, 60).alias("quote"))).alias("evidence"))
    good = F.to_json(F.struct(F.lit("answered").alias("status"), F.array(claim).alias("claims")))
    forms = F.array(
        F.struct(F.lit("good").alias("form"), good.alias("raw")),
        F.struct(F.lit("fenced").alias("form"), F.concat(F.lit("```json\n"), good, F.lit("\n```")).alias("raw")),
        F.struct(F.lit("wrapped").alias("form"), F.concat(F.lit("Here it is: "), good, F.lit(" I hope it helps.")).alias("raw")),
        F.struct(F.lit("torn").alias("form"), F.substring(good, F.lit(1), F.length(good) - 3).alias("raw")),
        F.struct(F.lit("no-claims").alias("form"), F.lit('{"status": "answered", "claims": []}').alias("raw")),
        F.struct(F.lit("number").alias("form"), F.lit('{"status": "answered", "claims": [{"text": 1, "evidence": []}]}').alias("raw")),
        F.struct(F.lit("declined").alias("form"), F.lit('{"status": "insufficient_evidence", "missing": "tests"}').alias("raw")),
        F.struct(F.lit("unknown").alias("form"), F.lit('{"status": "maybe"}').alias("raw")),
    )
    r = sup.select("support_id", F.explode(forms).alias("f")).select("support_id", F.col("f.form").alias("form"), F.col("f.raw").alias("raw"))
    return X.parsed(r).select("support_id", "form", "reason", F.size("reply.claims").alias("claims"))


def _claims(s, d):
    """First quotable line of every chunk: the deterministic stand-in for a model."""
    return C.chunks(s, d).select("chunk_id", X.extractive_claim(F.col("text")).alias("claim"))


def _suspects(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce(P.suspicious(F.col("text")), F.lit(False)).alias("suspect"))


QUERIES = {
    "imports_found": _imports,
    "exports_found": _exports,
    "imports_categories": _categories,
    "imports_aliases": _aliases,
    "imports_relative": _relative,
    "imports_neighbours": _hops,
    "entries_stats": _entry_stats,
    "entries_declared": _entries,
    "importers_asked": _asked,
    "importers_files": _importers,
    "calls_found": _calls,
    "definitions_called": _definitions,
    "definitions_best_chunk": _best_overlap,
    "symbols_enclosing": _enclosing,
    "evidence_verified": _verified,
    "evidence_admitted": _admitted,
    "evidence_not_shown": _not_shown,
    "evidence_claims": _claims,
    "evidence_suspects": _suspects,
    "citations_checked": _locators,
    "replies_parsed": _replies,
}

_FORMS = [
    r"(?:which|what)\s+(?:[A-Za-z0-9_]+\s+){0,2}?(?:modules?|files?|packages?|components?)\s+(?:import|imports|importing|require|requires)\s+(.+)$",
    r"who\s+(?:imports|requires)\s+(.+)$",
    r"where\s+is\s+(.+?)\s+(?:imported|required)(?:[^A-Za-z0-9_]|$)",
    r"(?:list|show|find)\s+(?:all\s+)?(?:the\s+)?(?:modules?|files?)\s+(?:that\s+)?(?:import|imports|importing|require|requires)\s+(.+)$",
]
_PHRASE = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(q, '(?i)(?:^|[^A-Za-z0-9_]){f}', 1)), '')" for f in _FORMS) + ")"
_PHRASES = f"iq AS (SELECT question_id, repo, regexp_replace(trim(question), '[?.!\\s]+$', '') AS q FROM {D.QUESTIONS}), ip AS (SELECT * FROM (SELECT question_id, repo, {_PHRASE} AS phrase FROM iq) WHERE phrase IS NOT NULL)"


def _word_terms(words: str) -> str:
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda w_: list_transform({D.split_identifier('w_')}, lambda p_: {D.stem('p_')}))), lambda k_: length(k_) >= 2))"


def importers_sql() -> str:
    """The importers of what questions ask about; begins after WITH."""
    words = lambda p: f"list_filter(regexp_split_to_array({p}, '[^A-Za-z0-9_$]+'), lambda v_: v_ <> '' AND lower(v_) NOT IN ({D.quoted(E.FILLER)}))"
    path_terms = D.path_terms("fx", "repo, file_id", "path")
    return f"""{_RESOLVED}, {_PHRASES}, ia AS (SELECT *, {words('phrase')} AS ws, regexp_matches(phrase, '(?i)^\\S+\\s+from\\s+.+$') AS has_from FROM ip),
ib AS (SELECT question_id, repo, CASE WHEN has_from THEN regexp_extract(phrase, '(?i)^(\\S+)\\s+from\\s+', 1) WHEN len(ws) = 1 THEN ws[1] END AS name, lower(ws[-1]) AS last, {_word_terms('ws')} AS words,
  NOT has_from AND (regexp_matches(phrase, '(?i)(^|[^A-Za-z0-9_])(module|file|helper|package)s?$') OR len(ws) > 1) AS module, CASE WHEN has_from THEN {_word_terms(words("regexp_extract(phrase, '(?i)^\\S+\\s+from\\s+(.+)$', 1)"))} END AS hint FROM ia),
pt AS {path_terms}, fc AS (SELECT file_id, repo, path, {D.file_class('path')} AS file_class FROM fx),
fm AS (SELECT question_id, last, len(words) AS n, f.file_id, f.path FROM (SELECT *, unnest(words) AS term FROM ib WHERE module AND len(words) > 0) x JOIN pt USING (repo, term) JOIN fc f ON f.file_id = pt.file_id AND f.file_class = 'source' GROUP BY question_id, last, words, f.file_id, f.path HAVING count(*) = len(words)),
fn AS (SELECT *, regexp_replace(lower({D.base_name('path')}), '[.][^.]+$', '') = last OR (regexp_replace(lower({D.base_name('path')}), '[.][^.]+$', '') = 'index' AND lower(string_split(path, '/')[-2]) = last) AS exact FROM fm),
ff AS (SELECT question_id, CASE WHEN count(*) = 1 THEN min(file_id) WHEN count(*) FILTER (WHERE exact) = 1 THEN min(file_id) FILTER (WHERE exact) END AS target FROM fn GROUP BY question_id),
bf AS (SELECT ff.question_id, r.file_id, r.line FROM ff JOIN res r ON r.target = ff.target),
nm AS (SELECT DISTINCT r.repo, r.file_id, r.line, r.spec, r.target, unnest(k.names) AS name FROM res r JOIN (SELECT file_id, line, {_NAMES} AS names FROM {_ROWS}) k ON k.file_id = r.file_id AND k.line = r.line),
pl AS (SELECT file_id, list(term) AS ts FROM pt GROUP BY file_id), bn AS (SELECT b.question_id, n.file_id, n.line FROM ib b JOIN nm n ON n.repo = b.repo AND n.name = b.name LEFT JOIN pl ON pl.file_id = n.target WHERE regexp_matches(b.name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AND b.question_id NOT IN (SELECT question_id FROM bf)
  AND (hint IS NULL OR (len(hint) > 0 AND CASE WHEN n.target IS NOT NULL THEN len(list_filter(hint, lambda t_: NOT list_contains(coalesce(ts, CAST([] AS VARCHAR[])), t_))) = 0 ELSE len(list_filter(hint, lambda u_: NOT contains(lower(n.spec), u_))) = 0 END))),
ih AS (SELECT question_id, file_id, min(line) AS line FROM (SELECT * FROM bf UNION ALL SELECT * FROM bn) GROUP BY ALL)
SELECT question_id, file_id, line, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN file_class = 'source' THEN 0 ELSE 1 END, path, file_id) AS rank FROM ih JOIN fc USING (file_id)"""


_NAMES = "list_filter(list_transform(string_split(regexp_extract(text, '\\{([^{}]*)\\}\\s*(?:from|=)', 1), ','), lambda n_: trim(regexp_replace(n_, '\\s+as\\s+.*|:.*|^\\s*type\\s+', '', 'g'))), lambda m_: m_ <> '')"
_CODE = "regexp_matches(path, '\\.([cm]?[jt]s|[jt]sx)$')"
_ROWS = f"(SELECT file_id, repo, sha, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {D.FILES} WHERE {_CODE})"
_IMPORTS = f"""i AS (SELECT file_id, repo, sha, path, line, unnest(list_concat(
  list_transform(regexp_extract_all(text, '(?:^|[\\s;}}])(?:from|import)\\s*["'']([^"''\\n]+)["'']', 1), lambda s_: {{'specifier': s_, 'kind': CASE WHEN regexp_matches(text, '^\\s*export\\b') THEN 'reexport' ELSE 'import' END}}),
  list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_$.])(?:require|import)\\(\\s*["'']([^"''\\n]+)["'']\\s*\\)', 1), lambda s_: {{'specifier': s_, 'kind': CASE WHEN contains(text, 'require(') THEN 'require' ELSE 'dynamic' END}}))) AS k FROM {_ROWS})"""


def _joined(folder: str, rel: str) -> str:
    """A relative path on a folder; '..' is taken to stand at the start of the path only, as in the test data."""
    p = f"list_filter(string_split({rel}, '/'), lambda a_: a_ NOT IN ('', '.'))"
    up = f"len(list_filter({p}, lambda b_: b_ = '..'))"
    d = f"list_filter(string_split({folder}, '/'), lambda c_: c_ <> '')"
    return f"array_to_string(list_concat(({d})[1:greatest(len({d}) - {up}, 0)], list_resize(CAST([] AS VARCHAR[]), greatest({up} - len({d}), 0), '..'), list_filter({p}, lambda e_: e_ <> '..')), '/')"


def _cands(base: str, declarations: bool = False) -> str:
    exts = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
    tail = [""] + ([".d.ts", "/index.d.ts"] if declarations else []) + exts + [f"/index{e}" for e in exts]
    swap = " ".join(f"WHEN ends_with({base}, '{e}') THEN [" + ", ".join(f"left({base}, length({base}) - {len(e)}) || '{t}'" for t in ts) + "]" for e, ts in {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}.items())
    return "list_concat([" + ", ".join(f"{base} || '{t}'" for t in tail) + f"], CASE {swap} ELSE CAST([] AS VARCHAR[]) END)"


def _hit(rows: str, keys: str, name: str) -> str:
    """keys and the file of the first candidate in ``cs`` (ordered by ``o`` before) that exists."""
    return (
        f"(SELECT {keys}, arg_min(f_, (o, pos)) AS {name} FROM (SELECT {keys}, repo AS r_, sha AS s_, o, unnest(cs) AS cand, generate_subscripts(cs, 1) AS pos FROM {rows}) x"
        f" JOIN (SELECT file_id AS f_, repo AS fr_, sha AS fs_, path AS fp_ FROM fx WHERE NOT excluded) ON fr_ = x.r_ AND fs_ = x.s_ AND fp_ = x.cand GROUP BY {keys})"
    )


_STRIPPED = "CASE WHEN json_valid(content) THEN content ELSE regexp_replace(regexp_replace(regexp_replace(content, '/\\*.*?\\*/', '', 'gs'), '(^|[^:\"])//[^\\n]*', '\\1', 'g'), ',(\\s*[}\\]])', '\\1', 'g') END"
_ENTRIES = f"""fx AS (SELECT file_id, repo, sha, path, content, array_to_string({D.dirs('path')}, '/') AS folder, {D.skip_reason('path')} IS NOT NULL AS excluded FROM {D.FILES}),
m0 AS (SELECT file_id, repo, sha, folder AS dir, {_STRIPPED} AS j FROM fx WHERE {D.base_name('path')} = 'package.json'), m AS (SELECT *, CASE WHEN json_type(j, '$.name') = 'VARCHAR' THEN json_extract_string(j, '$.name') ELSE '' END AS package FROM m0 WHERE json_valid(j)),
t0 AS (SELECT m.file_id, k.kind, k.n, e.id, json_extract_string(e.value, '$') AS target FROM m CROSS JOIN (SELECT unnest(['main', 'module', 'browser', 'bin', 'exports']) AS kind, unnest([0, 1, 2, 3, 4]) AS n) k, json_tree(m.j, '$.' || k.kind) e WHERE e.type = 'VARCHAR'),
t1 AS (SELECT * FROM t0 WHERE NOT regexp_matches(target, '.d.[cm]?ts$|.(css|json|map)$') AND NOT starts_with(target, '/')),
t2 AS (SELECT m.*, coalesce(t1.kind, 'main') AS entry_kind, CASE WHEN t1.target IS NULL THEN './index.js' WHEN starts_with(t1.target, '.') THEN t1.target ELSE './' || t1.target END AS target, coalesce(t1.n, 0) * 1000000 + coalesce(t1.id, 0) AS place FROM m LEFT JOIN t1 USING (file_id)),
t3 AS (SELECT *, {_joined("''", 'target')} AS rel FROM t2), t4 AS (SELECT *, string_split(rel, '/') AS seg FROM t3),
t5 AS (SELECT *, array_to_string(seg[2:], '/') AS tail, {_joined('dir', 'rel')} AS b0, seg[-1] AS last FROM t4),
t6 AS (SELECT *, 0 AS o, list_concat({_cands('b0')}, CASE WHEN seg[1] IN ('dist', 'build', 'out', 'distribution', 'esm', 'cjs', 'lib') THEN list_concat({", ".join(_cands('(' + _joined('dir', f"'{x}/' || tail") + ')') for x in ('src', 'source', 'lib'))}) ELSE CAST([] AS VARCHAR[]) END,
  {", ".join(_cands('(' + _joined('dir', f"'{x}/' || last") + ')') for x in ('src', 'source', 'lib'))}) AS cs FROM t5),
en AS (SELECT t6.file_id, t6.repo, t6.sha, dir, package, t6.place, entry_kind, target, entry_file_id FROM t6 LEFT JOIN {_hit('t6', 'file_id, place', 'entry_file_id')} h ON h.file_id = t6.file_id AND h.place = t6.place)"""
_KEYS = "repo, sha, folder, spec"
_RESOLVED = f"""{_IMPORTS}, {_ENTRIES}, r AS (SELECT file_id, repo, sha, path, line, k.specifier AS spec, k.kind AS kind, array_to_string({D.dirs('path')}, '/') AS folder FROM i),
q0 AS (SELECT DISTINCT {_KEYS} FROM r), near AS (SELECT *, {_joined('folder', 'spec')} AS base FROM q0 WHERE starts_with(spec, '.')),
n1 AS (SELECT *, 0 AS o, {_cands('base', True)} AS cs FROM near), h1 AS (SELECT * FROM {_hit('n1', _KEYS, 'file_hit')}),
shut AS (SELECT DISTINCT x.repo, x.sha, x.folder, x.spec FROM (SELECT {_KEYS}, unnest({_cands('base')}) AS cand FROM near) x JOIN fx f ON f.repo = x.repo AND f.sha = x.sha AND f.path = x.cand AND f.excluded),
bydir AS (SELECT repo, sha, dir, arg_min(entry_file_id, (file_id, place)) AS dir_hit FROM en WHERE entry_file_id IS NOT NULL GROUP BY ALL), h2 AS (SELECT n.repo, n.sha, n.folder, n.spec, dir_hit FROM near n JOIN bydir b ON b.repo = n.repo AND b.sha = n.sha AND b.dir = n.base),
bare AS (SELECT * FROM q0 WHERE NOT starts_with(spec, '.') AND NOT starts_with(spec, 'node:') AND spec NOT IN ({D.quoted(BUILTINS)})),
named AS (SELECT repo, sha, package, arg_max(dir, file_id) AS dir, arg_min(entry_file_id, (file_id, place)) FILTER (WHERE entry_file_id IS NOT NULL) AS entry FROM en WHERE package <> '' GROUP BY ALL),
w0 AS (SELECT b.*, n.dir, n.entry, substr(spec, length(n.package) + 2) AS sub FROM bare b JOIN named n ON n.repo = b.repo AND n.sha = b.sha AND n.package = CASE WHEN starts_with(spec, '@') THEN array_to_string(string_split(spec, '/')[1:2], '/') ELSE string_split(spec, '/')[1] END),
w1 AS (SELECT *, {_joined('dir', 'sub')} AS b1, {_joined("dir || '/src'", 'sub')} AS b2, 0 AS o FROM w0 WHERE sub <> ''), w2 AS (SELECT *, list_concat({_cands('b1')}, {_cands('b2')}) AS cs FROM w1), h3 AS (SELECT * FROM {_hit('w2', _KEYS, 'sub_id')}),
c0 AS (SELECT file_id AS config_id, repo, sha, folder AS dir, {_STRIPPED} AS j FROM fx WHERE regexp_matches(path, '(^|/)(tsconfig[^/]*|jsconfig)[.]json$')),
c1 AS (SELECT *, {_joined('dir', "coalesce(json_extract_string(j, '$.compilerOptions.baseUrl'), '.')")} AS base_dir, json_extract_string(j, '$.compilerOptions.baseUrl') IS NOT NULL AS has_base FROM c0 WHERE json_valid(j)),
c2 AS (SELECT c1.* EXCLUDE (j), e.key AS pattern, e.id AS place, unnest(from_json(e.value, '["VARCHAR"]')) AS target FROM c1, json_each(c1.j, '$.compilerOptions.paths') e UNION ALL SELECT * EXCLUDE (j), '*', 1000000000, '*' FROM c1 WHERE has_base),
up AS (SELECT {_KEYS}, unnest(list_transform(range(0, len(list_filter(string_split(folder, '/'), lambda g_: g_ <> '')) + 1), lambda n_: array_to_string(string_split(folder, '/')[1:n_], '/'))) AS dir FROM bare),
a0 AS (SELECT u.*, config_id, base_dir, place, pattern, target, instr(pattern, '*') AS star FROM up u JOIN c2 USING (repo, sha, dir)),
a1 AS (SELECT *, CASE WHEN star = 0 AND pattern = spec THEN target WHEN star > 0 AND starts_with(spec, left(pattern, star - 1)) AND ends_with(spec, substr(pattern, star + 1)) AND length(spec) >= length(pattern) - 1 THEN replace(target, '*', substr(spec, star, length(spec) - length(pattern) + 1)) END AS t FROM a0),
a2 AS (SELECT *, {_joined('base_dir', 't')} AS base, (-length(dir), config_id, place) AS o FROM a1 WHERE t IS NOT NULL), a3 AS (SELECT *, {_cands('base')} AS cs FROM a2), h4 AS (SELECT * FROM {_hit('a3', _KEYS, 'alias_id')}),
found AS (SELECT q0.*, CASE WHEN starts_with(spec, '.') THEN coalesce(file_hit, dir_hit) ELSE coalesce(alias_id, CASE WHEN sub = '' THEN entry ELSE sub_id END) END AS target,
  CASE WHEN starts_with(spec, '.') AND coalesce(file_hit, dir_hit) IS NOT NULL THEN 'relative:resolved' WHEN starts_with(spec, '.') AND regexp_matches(spec, '(?i)[.](css|scss|sass|less|svg|png|jpg|jpeg|gif|json|md|html|txt|wasm|node|woff|woff2)$') THEN 'relative:unresolved-asset'
  WHEN starts_with(spec, '.') AND shut.spec IS NOT NULL THEN 'relative:unresolved-excluded-file' WHEN starts_with(spec, '.') THEN 'relative:unresolved-missing' WHEN starts_with(spec, 'node:') OR spec IN ({D.quoted(BUILTINS)}) THEN 'bare:node-builtin'
  WHEN alias_id IS NOT NULL THEN 'alias-or-baseurl:resolved' WHEN w0.spec IS NOT NULL THEN 'workspace-package:' || CASE WHEN CASE WHEN sub = '' THEN entry ELSE sub_id END IS NULL THEN 'un' ELSE '' END || 'resolved'
  WHEN starts_with(spec, '@/') OR starts_with(spec, '~/') OR starts_with(spec, '#') THEN 'alias:unresolved' ELSE 'bare:external-package' END AS resolution
  FROM q0 LEFT JOIN h1 USING ({_KEYS}) LEFT JOIN shut USING ({_KEYS}) LEFT JOIN h2 USING ({_KEYS}) LEFT JOIN w0 USING ({_KEYS}) LEFT JOIN h3 USING ({_KEYS}) LEFT JOIN h4 USING ({_KEYS})),
res AS (SELECT r.*, f.target, f.resolution FROM r JOIN found f USING ({_KEYS}))"""
_SHOWN = f"""(SELECT f.file_id, evidence.start_line AS a, evidence.end_line AS b FROM (SELECT DISTINCT ON (support_id) support_id, trim(regexp_replace(trim(lower(repo)), '\\.git\\s*$', '')) AS repo, evidence FROM support) s JOIN {D.FILES} f ON f.repo = s.repo AND f.path = s.evidence.path WHERE evidence IS NOT NULL)"""
_SYM = "(SELECT DISTINCT symbol_id, file_id, repo, name, kind, start_line, greatest(start_line, coalesce(end_line, start_line)) AS end_line FROM extracted_symbols)"

SQL = {
    "imports_found": f"WITH {_IMPORTS} SELECT file_id, line, k.specifier AS specifier, k.kind AS kind, count(*) AS n FROM i GROUP BY ALL",
    "exports_found": f"""WITH n AS (SELECT file_id, line, coalesce(nullif(regexp_extract(text, '^export\\s+(?:default\\s+)?(?:declare\\s+)?(?:abstract\\s+)?(?:async\\s+)?(?:function\\*?|class|const|let|var|interface|type|enum)\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), ''),
  nullif(regexp_extract(text, '^(?:module\\.)?exports\\.([A-Za-z_$][A-Za-z0-9_$]*)\\s*=', 1), '')) AS name FROM {_ROWS}) SELECT file_id, name, line FROM n WHERE name IS NOT NULL""",
    "imports_categories": f"""WITH {_RESOLVED}, n AS (SELECT repo, resolution, count(*) AS imports FROM res GROUP BY ALL),
g AS (SELECT repo, resolution, path || ' -> ' || spec AS sample, min(file_id) AS f, min(line) AS l FROM res WHERE contains(resolution, 'unresolved') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY repo, resolution ORDER BY f, l, sample) AS r FROM g)
SELECT n.*, (SELECT string_agg(sample, chr(10) ORDER BY r) FROM k WHERE k.repo = n.repo AND k.resolution = n.resolution AND r <= 8) AS samples FROM n""",
    "imports_aliases": f"WITH {_RESOLVED} SELECT DISTINCT repo, sha, folder, spec AS specifier, target AS target_file_id, resolution FROM res WHERE NOT starts_with(spec, '.') AND resolution NOT IN ('bare:node-builtin')",
    "imports_relative": f"""WITH {_RESOLVED} SELECT count(*) FILTER (WHERE starts_with(resolution, 'relative:')) AS relative_total, count(*) FILTER (WHERE resolution = 'relative:resolved') AS relative_resolved, count(*) AS imports FROM res""",
    "importers_files": f"WITH {importers_sql()}",
    "importers_asked": f"""WITH {_PHRASES} SELECT question_id, regexp_replace(phrase, '[`"'']', '', 'g') AS name FROM ip""",
    "entries_declared": f"WITH {_ENTRIES} SELECT file_id, dir, package, entry_kind, target, entry_file_id FROM en",
    "entries_stats": f"""WITH {_ENTRIES} SELECT repo, count(*) AS declared, count(entry_file_id) AS resolved, coalesce(string_agg(DISTINCT CASE WHEN dir = '' THEN '.' ELSE dir END || ':' || target, chr(10) ORDER BY CASE WHEN dir = '' THEN '.' ELSE dir END || ':' || target) FILTER (WHERE entry_file_id IS NULL), '') AS unresolved FROM en GROUP BY repo""",
    "imports_neighbours": f"WITH {_RESOLVED}, e AS (SELECT DISTINCT file_id, target AS near FROM res WHERE target IS NOT NULL) SELECT file_id, near FROM e UNION SELECT near, file_id FROM e",
    "calls_found": f"""WITH m AS (SELECT chunk_id, unnest(regexp_extract_all(text, '(#?[A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1)) AS name FROM {D.CHUNKS}) SELECT chunk_id, name, count(*) AS calls FROM m WHERE name NOT IN ({D.quoted(E.NOT_A_CALL)}) GROUP BY ALL""",
    "definitions_called": f"""WITH {_RESOLVED}, cm AS (SELECT repo, file_id, unnest(regexp_extract_all(text, '(#?[A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1)) AS name FROM {D.CHUNKS}), cl AS (SELECT DISTINCT repo, file_id, regexp_replace(name, '^#', '') AS name FROM cm WHERE name NOT IN ({D.quoted(E.NOT_A_CALL)})),
sy AS (SELECT s.* FROM {_SYM} s JOIN fx USING (file_id) WHERE s.kind IN ('function', 'method', 'variable') AND s.end_line > s.start_line AND {D.file_class('path')} = 'source'), ed AS (SELECT DISTINCT file_id, target FROM res WHERE target IS NOT NULL),
j AS (SELECT cl.repo, cl.file_id AS from_file, cl.name, sy.symbol_id, CASE WHEN sy.file_id = cl.file_id THEN 0 WHEN ed.target IS NOT NULL THEN 1 ELSE 2 END AS tier FROM cl JOIN sy ON sy.repo = cl.repo AND sy.name = cl.name LEFT JOIN ed ON ed.file_id = cl.file_id AND ed.target = sy.file_id),
g AS (SELECT repo, from_file, name, {", ".join(f"count(*) FILTER (tier = {t}) AS n{t}, min(symbol_id) FILTER (tier = {t}) AS s{t}" for t in range(3))} FROM j GROUP BY ALL)
SELECT * FROM (SELECT from_file, name, CASE WHEN n0 > 0 THEN CASE WHEN n0 = 1 THEN s0 END WHEN n1 > 0 THEN CASE WHEN n1 = 1 THEN s1 END WHEN n2 = 1 THEN s2 END AS symbol_id FROM g) WHERE symbol_id IS NOT NULL""",
    "definitions_best_chunk": f"""WITH j AS (SELECT s.symbol_id, c.chunk_id, least(c.end_line, least(s.end_line, s.start_line + 39)) - greatest(c.start_line, s.start_line) + 1 AS o FROM {_SYM} s JOIN {D.CHUNKS} c ON s.file_id = c.file_id AND c.start_line <= least(s.end_line, s.start_line + 39) AND c.end_line >= s.start_line)
SELECT symbol_id, arg_min(chunk_id, -o * 1000000000000 + chunk_id) AS chunk_id, max(o) AS overlap FROM j GROUP BY symbol_id""",
    "symbols_enclosing": f"""WITH l AS (SELECT DISTINCT file_id, a AS line FROM {_SHOWN}) SELECT l.file_id, l.line, arg_min(s.symbol_id, (s.end_line - s.start_line) * 1000000000000 + s.symbol_id) AS symbol_id FROM l JOIN {_SYM} s ON s.file_id = l.file_id AND l.line BETWEEN s.start_line AND s.end_line GROUP BY ALL""",
    "evidence_verified": f"""WITH {LEXICAL}, o AS (SELECT DISTINCT chunk_id, end_line AS e FROM extracted_chunks), j AS (SELECT t.question_id, t.rank, t.chunk_id, t.start_line, coalesce(o.e, t.end_line - 1) AS e, left(sha1(c.text), 12) AS h, string_split(f.content, chr(10)) AS lines
  FROM top t JOIN o USING (chunk_id) JOIN c USING (chunk_id) JOIN {D.FILES} f ON f.file_id = t.file_id),
x AS (SELECT *, start_line < 1 OR e > len(lines) OR start_line > e AS bad FROM j), y AS (SELECT *, CASE WHEN NOT bad THEN array_to_string(lines[start_line:e], chr(10)) END AS text FROM x)
SELECT question_id, rank, chunk_id, CASE WHEN bad THEN 'range-outside-file' WHEN left(sha1(text), 12) <> h THEN 'source-mismatch' END AS reason,
coalesce(regexp_matches(text, '{P.SUSPICIOUS}'), false) AS suspect FROM y""",
    "evidence_admitted": f"""WITH RECURSIVE {LEXICAL}, s AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k, chunk_id, length(c.text) AS chars FROM top JOIN c USING (chunk_id)),
w AS (SELECT question_id, k, chunk_id, chars, true AS ok, 1 AS n, chars AS total FROM s WHERE k = 1 UNION ALL
  SELECT s.question_id, s.k, s.chunk_id, s.chars, a, w.n + CASE WHEN a THEN 1 ELSE 0 END, w.total + CASE WHEN a THEN s.chars ELSE 0 END FROM w JOIN s ON s.question_id = w.question_id AND s.k = w.k + 1, LATERAL (SELECT w.n < 8 AND w.total + s.chars <= 6000 AS a))
SELECT question_id, 'E' || n AS evidence_id, chunk_id, chars FROM w WHERE ok""",
    "evidence_not_shown": f"""WITH s AS (SELECT * FROM {_SHOWN}) SELECT c.chunk_id, c.file_id FROM {D.CHUNKS} c WHERE c.file_id IN (SELECT file_id FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.file_id = c.file_id AND c.start_line <= s.b AND c.end_line >= s.a)""",
    "evidence_claims": f"""SELECT chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda s_: trim(s_)), lambda x_: length(x_) >= 12 AND NOT regexp_matches(x_, '^(//|/?\\*|#)'))[1] AS claim FROM {D.CHUNKS}""",
    "evidence_suspects": f"SELECT doc_id, coalesce(regexp_matches(text, '{P.SUSPICIOUS}'), false) AS suspect FROM documents",
    "citations_checked": f"""WITH s AS (SELECT DISTINCT ON (support_id) support_id, trim(regexp_replace(trim(lower(repo)), '\\.git\\s*$', '')) AS repo, evidence FROM support),
f AS (SELECT repo, path, arg_max(n, sha || lpad(CAST(n AS VARCHAR), 9, '0')) AS n FROM (SELECT repo, path, sha, {D.line_count('content')} AS n FROM {D.FILES}) GROUP BY repo, path),
j AS (SELECT s.support_id, evidence.start_line AS a0, evidence.end_line AS b0, f.n FROM s LEFT JOIN f ON f.repo = s.repo AND f.path = s.evidence.path), k AS (SELECT *, coalesce(a0, b0) AS a, coalesce(b0, a0) AS b FROM j)
SELECT support_id, CASE WHEN n IS NULL THEN 'unknown-evidence-id' WHEN a IS NULL THEN NULL WHEN a < 1 OR b < 1 THEN 'invalid-line-number' WHEN a > b THEN 'reversed-range' WHEN b > n THEN 'range-beyond-file' WHEN a < 1 OR b > least(n, 80) THEN 'outside-evidence-range' END AS reason FROM k""",
    "replies_parsed": """WITH f AS (SELECT unnest(['good', 'fenced', 'wrapped', 'torn', 'no-claims', 'number', 'declined', 'unknown']) AS form), s AS (SELECT DISTINCT support_id, claim FROM support)
SELECT support_id, form, CASE form WHEN 'torn' THEN 'not a JSON object' WHEN 'no-claims' THEN 'claims must be a list of 1 to 8' WHEN 'number' THEN 'claim text missing or too long' WHEN 'unknown' THEN 'status unknown' END AS reason,
CASE WHEN form IN ('good', 'fenced', 'wrapped') THEN 1 END AS claims FROM s CROSS JOIN f""",
}
