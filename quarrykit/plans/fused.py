"""SQL of the fused search, its features and all that is measured with them."""

from __future__ import annotations

from quarrykit import config as C
from quarrykit.plans import dialect as D
from quarrykit.plans.graph import _RESOLVED

_O = C.SearchOptions()
_NON_SOURCE = "(?i)(^|[^A-Za-z0-9_])(" + "|".join(C.NON_SOURCE_WORDS) + ")([^A-Za-z0-9_]|$)"
_ENTRY = "(?i)(^|[^A-Za-z0-9_])(entry[- ]?points?|main (file|module)|bin|cli|command[- ]line|start ?up|bootstrap)([^A-Za-z0-9_]|$)"
_IDF = "ln(1.0 + (n - d + 0.5) / (d + 0.5))"
_KEPT = f"(NOT (ax.intent AND x IN ({D.quoted(C.ENTRY_TERMS)})))"

FUSED = f"""{_RESOLVED}, c AS (SELECT * FROM {D.CHUNKS}), q AS (SELECT * FROM {D.QUESTIONS}),
ax AS (SELECT question_id, repo, regexp_matches(question, '{_ENTRY}') AS intent, regexp_matches(question, '{_NON_SOURCE}') AS any_class FROM q),
qt AS (SELECT ax.repo, ax.question_id, x AS term FROM (SELECT question_id, term AS x FROM {D.question_terms('q', 'question_id', 'question')}) JOIN ax USING (question_id) WHERE {_KEPT}),
qi AS (SELECT ax.repo, ax.question_id, x AS ident FROM (SELECT question_id, name AS x FROM {D.question_identifiers('q', 'question_id', 'question')}) JOIN ax USING (question_id) WHERE {_KEPT}),
{D.bm25('c', 'chunk_id', 'repo', 'qt', 'question_id', _O.k1, _O.b)},
lex AS (SELECT question_id, chunk_id, round(sum(weight), 12) AS bm25 FROM hits GROUP BY question_id, chunk_id),
sy AS (SELECT DISTINCT ON (symbol_id) symbol_id, file_id, repo, name, coalesce(qualified_name, name) AS shown, start_line FROM extracted_symbols),
sn AS (SELECT DISTINCT repo, symbol_id, unnest([lower(name), lower(shown)]) AS ident FROM sy), s1 AS (SELECT question_id, symbol_id, 1.5 AS score FROM qi JOIN sn USING (repo, ident)),
sp AS (SELECT DISTINCT repo, symbol_id, term FROM (SELECT repo, symbol_id, {D.stem('t')} AS term FROM (SELECT repo, symbol_id, unnest({D.split_identifier('name')}) AS t FROM sy)) WHERE length(term) >= 2),
sw AS (SELECT repo, symbol_id, term, {_IDF} AS w FROM (SELECT sp.repo, symbol_id, sp.term, st.blocks AS n, coalesce(df.df, 0) AS d FROM sp JOIN st ON st.repo = sp.repo LEFT JOIN df ON df.repo = sp.repo AND df.term = sp.term)),
stot AS (SELECT symbol_id, sum(w) AS total FROM sw GROUP BY symbol_id), sh AS (SELECT question_id, symbol_id, sum(w) AS hit FROM qt JOIN sw USING (repo, term) GROUP BY ALL),
s2 AS (SELECT question_id, symbol_id, CASE WHEN total > 0 THEN hit / total ELSE 0 END AS score FROM sh JOIN stot USING (symbol_id)),
s3 AS (SELECT question_id, symbol_id, max(score) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 WHERE score >= 0.5) GROUP BY ALL),
pl AS (SELECT symbol_id, shown, chunk_id FROM (SELECT sy.symbol_id, shown, c.chunk_id, row_number() OVER (PARTITION BY sy.symbol_id ORDER BY c.start_line DESC, c.chunk_id) AS r FROM sy JOIN c ON c.file_id = sy.file_id AND sy.start_line BETWEEN c.start_line AND c.end_line) WHERE r = 1),
ls AS (SELECT question_id, chunk_id, round(max(score), 12) AS symbol, array_to_string(list_sort(list(DISTINCT shown))[1:5], ' ') AS names FROM s3 JOIN pl USING (symbol_id) GROUP BY ALL),
pt AS {D.path_terms('fx', 'repo, file_id', 'path')}, pn AS (SELECT repo, count(*) AS n FROM fx GROUP BY repo), pd AS (SELECT repo, term, count(*) AS d FROM pt GROUP BY ALL),
pw AS (SELECT repo, question_id, term, {_IDF} AS w FROM qt JOIN pd USING (repo, term) JOIN pn USING (repo)), ptot AS (SELECT question_id, sum(w) AS total FROM pw GROUP BY ALL),
ps AS (SELECT question_id, file_id, round(sum(w) / any_value(total), 12) AS path FROM pw JOIN pt USING (repo, term) JOIN ptot USING (question_id) WHERE total > 0 GROUP BY question_id, file_id),
pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY path DESC, file_id) AS r FROM ps) WHERE r <= {_O.path_files}),
lp AS (SELECT question_id, chunk_id, path FROM (SELECT pb.question_id, c.chunk_id, pb.path, row_number() OVER (PARTITION BY pb.question_id, pb.file_id ORDER BY coalesce(bm25, 0) DESC, c.chunk_id) AS r FROM pb JOIN c ON c.file_id = pb.file_id
  LEFT JOIN lex ON lex.question_id = pb.question_id AND lex.chunk_id = c.chunk_id) WHERE r <= {_O.per_file}),
pe AS (SELECT DISTINCT repo, entry_file_id AS file_id, CASE WHEN package = '' THEN dir ELSE package END AS package FROM en WHERE entry_file_id IS NOT NULL), pk AS {D.path_terms('pe', 'repo, file_id, package', 'package')},
pel AS (SELECT DISTINCT file_id, package, term FROM (SELECT file_id, package, term FROM pk UNION ALL SELECT pe.file_id, package, term FROM pe JOIN pt ON pt.file_id = pe.file_id)),
qn AS (SELECT question_id, count(*) AS n FROM qt GROUP BY ALL), fch AS (SELECT file_id, arg_min(chunk_id, (start_line, chunk_id)) AS chunk_id FROM c GROUP BY file_id),
le AS (SELECT ax.question_id, fch.chunk_id, max({_O.entry_base} + 0.5 * least(1.0, (SELECT count(*) FROM pel JOIN qt ON qt.question_id = ax.question_id AND qt.term = pel.term WHERE pel.file_id = pe.file_id AND pel.package = pe.package) / greatest(coalesce(qn.n, 0), 1))) AS entry
  FROM ax JOIN pe ON pe.repo = ax.repo JOIN fch ON fch.file_id = pe.file_id LEFT JOIN qn ON qn.question_id = ax.question_id WHERE ax.intent GROUP BY ALL),
un AS (SELECT question_id, chunk_id, bm25, NULL AS symbol, NULL AS names, NULL AS path, NULL AS entry FROM lex UNION ALL SELECT question_id, chunk_id, NULL, symbol, names, NULL, NULL FROM ls
  UNION ALL SELECT question_id, chunk_id, NULL, NULL, NULL, path, NULL FROM lp UNION ALL SELECT question_id, chunk_id, NULL, NULL, NULL, NULL, entry FROM le),
cd AS (SELECT question_id, chunk_id, coalesce(max(bm25), 0) AS bm25, coalesce(max(symbol), 0) AS symbol, max(names) AS names, coalesce(max(path), 0) AS path, coalesce(max(entry), 0) AS entry FROM un GROUP BY ALL),
ce AS (SELECT cd.*, c.file_id, max(cd.bm25) OVER (PARTITION BY question_id) AS most, CASE WHEN NOT any_class AND {D.file_class('c.path')} IN ('test', 'example', 'docs') THEN 0.3 ELSE 1.0 END AS weight FROM cd JOIN c USING (chunk_id) JOIN ax USING (question_id)),
cf AS (SELECT *, round((CASE WHEN most > 0 THEN bm25 / most ELSE 0 END + {_O.symbol_weight} * least(symbol, 1.5) + {_O.path_weight} * path + {_O.entry_weight} * entry) * weight, 12) AS score FROM ce),
se AS (SELECT question_id, file_id, seed, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS seed FROM cf) WHERE seed <= {_O.import_seeds}),
ed AS (SELECT file_id, target AS near, 0 AS dd, line AS pp FROM res WHERE target IS NOT NULL UNION ALL SELECT target, file_id, 1, line FROM res WHERE target IS NOT NULL),
ho AS (SELECT se.question_id, ed.near AS file_id, min((seed, dd, pp)) AS o, max(score) AS parent FROM se JOIN ed USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM se s WHERE s.question_id = se.question_id AND s.file_id = ed.near) GROUP BY ALL),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY o, file_id) AS r FROM ho) WHERE r <= {_O.max_neighbours}),
bc AS (SELECT question_id, file_id, arg_min(chunk_id, (-bm25, chunk_id)) AS chunk_id FROM cf WHERE bm25 > 0 GROUP BY ALL), bo AS (SELECT question_id, chunk_id, {_O.import_decay} * parent AS bonus FROM nb JOIN bc USING (question_id, file_id)),
cx AS (SELECT cf.* EXCLUDE (score), round(greatest(score, score + coalesce(bonus, 0)), 12) AS score FROM cf LEFT JOIN bo USING (question_id, chunk_id)),
cy AS (SELECT *, row_number() OVER (PARTITION BY question_id, file_id ORDER BY score DESC, chunk_id) AS r FROM cx),
fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cy WHERE r <= {_O.per_file}) WHERE rank <= {_O.k})"""

FEATURES = f"""{FUSED}, ft AS (SELECT repo, question_id, term, {_IDF} AS w FROM (SELECT qt.repo, question_id, qt.term, st.blocks AS n, coalesce(df.df, 0) AS d FROM qt JOIN st ON st.repo = qt.repo LEFT JOIN df ON df.repo = qt.repo AND df.term = qt.term)),
ftot AS (SELECT question_id, sum(w) AS total FROM ft GROUP BY ALL),
fs AS (SELECT ft.question_id, ft.term, any_value(w) AS w, min(rank) AS r FROM ft JOIN fz ON fz.question_id = ft.question_id AND rank <= 3 JOIN post ON post.repo = ft.repo AND post.chunk_id = fz.chunk_id AND post.term = ft.term GROUP BY ALL),
fcv AS (SELECT question_id, sum(w) AS w3, sum(CASE WHEN r = 1 THEN w ELSE 0 END) AS w1 FROM fs GROUP BY ALL),
fr AS (SELECT question_id, max(round(score, 6)) FILTER (rank = 1) AS top_score, max(round(score, 6)) FILTER (rank = 2) AS second, bool_or(round(symbol, 6) >= 1.5) FILTER (rank <= 3) AS exact_symbol, bool_or(round(path, 6) > 0) FILTER (rank = 1) AS path_hit, count(*) AS evidence FROM fz GROUP BY ALL),
qin AS (SELECT question_id, count(*) AS n FROM qi GROUP BY ALL),
ff AS (SELECT ax.question_id, coalesce(top_score, 0) AS top_score, round(coalesce(top_score, 0) - coalesce(second, 0), 6) AS margin, round(CASE WHEN total > 0 THEN coalesce(w3, 0) / total ELSE 0 END, 6) AS idf_coverage,
  round(CASE WHEN total > 0 THEN coalesce(w1, 0) / total ELSE 0 END, 6) AS top1_coverage, coalesce(exact_symbol, false) AS exact_symbol, coalesce(path_hit, false) AS path_hit, coalesce(evidence, 0) AS evidence, coalesce(qn.n, 0) AS term_count, coalesce(qin.n, 0) AS identifier_count
  FROM ax LEFT JOIN fr USING (question_id) LEFT JOIN ftot USING (question_id) LEFT JOIN fcv USING (question_id) LEFT JOIN qn USING (question_id) LEFT JOIN qin USING (question_id))"""

QUERIES: dict = {}
SQL = {
    "search_fused_top10": f"WITH {FUSED} SELECT question_id, rank, chunk_id, file_id, round(score, 6) AS score, round(bm25, 6) AS bm25, round(symbol, 6) AS symbol, round(path, 6) AS path, round(entry, 6) AS entry, names FROM fz",
    "search_features": f"WITH {FEATURES} SELECT *, CASE WHEN evidence = 0 OR idf_coverage < 0.3 THEN 'insufficient' WHEN idf_coverage < 0.5 THEN 'caution' ELSE 'answer' END AS decision FROM ff",
}
