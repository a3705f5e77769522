"""Queries over a few planted rows: cases that the test tables do not hold, compared with SQL like all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import paths as P
from quarrykit.functions import requests as RQ
from quarrykit.operators import evidence as E
from quarrykit.operators import imports as M
from quarrykit.operators import index as I
from quarrykit.plans import dialect as D
from quarrykit.session import checkpointed

SHA = "a" * 40
_MANIFEST = '{"name": "@acme/core", "exports": {".": {"import": "./dist/main.js", "types": "./dist/main.d.ts"}, "./extra": ["./lib/extra.mjs"]}, "bin": {"acme": "bin/run"}, "browser": {"./a": false}}'
_APP = """import { open, close as shut } from "./store";
import fs from "fs";
import { join } from "node:path";
import "./theme.css";
import gone from "./gone";
import built from "./dist/out.js";
import { gauge } from "@/util/gauge";
import wide from "shared/wide";
import core from "@acme/core";
import extra from "@acme/core/extra";
import lost from "@acme/core/lost";
import hash from "#hash";
import react from "react";
import part from "./part";
const x = require("../plain");
export { open } from "./store.js";
"""
FILES = [
    (1, 1, "acme/app", SHA, "src/app.ts", _APP),
    (2, 1, "acme/app", SHA, "src/store.ts", "export function open() {}\n"),
    (3, 1, "acme/app", SHA, "src/dist/out.js", "x"),
    (4, 1, "acme/app", SHA, "tsconfig.json", '{ // rules\n "compilerOptions": { "baseUrl": "./base", "paths": { "@/*": ["./none/*", "../src/*"], }, } }'),
    (5, 1, "acme/app", SHA, "src/util/gauge.tsx", "export const gauge = 1;\n"),
    (6, 1, "acme/app", SHA, "base/shared/wide.js", "module.exports = 1;\n"),
    (7, 1, "acme/app", SHA, "packages/core/package.json", _MANIFEST),
    (8, 1, "acme/app", SHA, "packages/core/src/main.ts", "export default 1;\n"),
    (9, 1, "acme/app", SHA, "packages/core/src/extra.mts", "export default 1;\n"),
    (10, 1, "acme/app", SHA, "packages/core/bin/run.js", "#!/usr/bin/env node\n"),
    (11, 1, "acme/app", SHA, "src/part/package.json", '{"main": "lib/start.js"}'),
    (12, 1, "acme/app", SHA, "src/part/src/start.ts", "export {};\n"),
    (13, 1, "acme/app", SHA, "plain.jsx", "import { open } from './src/store';\nimport { open as o2 } from 'other/store';\n"),
    (14, 1, "acme/app", SHA, "test/store.test.ts", "import { open } from '../src/store';\n"),
    (15, 1, "acme/app", SHA, "src/part/tsconfig.json", '{"compilerOptions": {"paths": {"@/util/gauge": ["./src/start.ts"]}}}'),
    (16, 1, "acme/app", SHA, "src/part/use.ts", 'import g from "@/util/gauge";\nimport again from "@/util/gauge.tsx";\n'),
    (17, 1, "acme/app", SHA, "broken/package.json", "{"),
    (18, 1, "acme/other", SHA, "src/store.ts", "export const other = 1;\n"),
    (18, 1, "acme/other", SHA, "src/store.ts", "export const other = 1;\n"),
]
FILE_COLUMNS = "file_id BIGINT, build_id BIGINT, repo STRING, sha STRING, path STRING, content STRING"
QUESTIONS = [
    (1, "acme/app", "Which modules import `open`?"), (2, "acme/app", "Who imports src/store?"), (3, "acme/app", "Which files import open from ./src/store?"),
    (4, "acme/app", "Where is gauge imported?"), (5, "acme/other", "Which modules import open?"), (6, "acme/app", "How does open work?"), (7, "acme/app", "Which files import nothing at all here?"),
]
QUESTION_COLUMNS = "question_id BIGINT, repo STRING, question STRING"


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def cte(name: str, rows: list[tuple], columns: str) -> str:
    """The rows as a common table expression that takes the place of the table of that name."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"{name}({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def _frame(s, rows, columns):
    return s.createDataFrame(rows, columns)


def _planted(s):
    f = _frame(s, FILES, FILE_COLUMNS)
    e = checkpointed(M.entries(M.packages(f), f))
    return f, e, M.resolved(M.import_rows(f), f, e, M.compiler_configs(f))


def _imports(s, d):
    return _planted(s)[2].select("file_id", "line", "specifier", "kind", "target_file_id", "resolution")


def _entries(s, d):
    return _planted(s)[1].select("file_id", "dir", "package", "entry_kind", "target", "entry_file_id")


def _importers(s, d):
    f, _, r = _planted(s)
    return E.importers(_frame(s, QUESTIONS, QUESTION_COLUMNS), r, I.files(f)).select("question_id", "file_id", "line", "rank")


CHUNKS = [(100 + i, i, 1, n) for i, n in ((1, 15), (2, 1), (5, 1), (9, 1), (12, 1), (13, 2), (14, 1), (16, 2))]
CHUNK_COLUMNS = "chunk_id BIGINT, file_id BIGINT, start_line INT, end_line INT"
SHOWN = [(1, 13, 1, 1), (4, 2, 1, 1)]
SHOWN_COLUMNS = "question_id BIGINT, file_id BIGINT, start_line INT, end_line INT"


def _importer_blocks(s, d):
    f, _, r = _planted(s)
    found = E.importers(_frame(s, QUESTIONS, QUESTION_COLUMNS), r, I.files(f))
    return E.importer_blocks(found, _frame(s, CHUNKS, CHUNK_COLUMNS), _frame(s, SHOWN, SHOWN_COLUMNS), 2).select("question_id", "chunk_id", "place")


# question_id, repo, file_id, name, pos of calls in the blocks shown; symbols with their best chunk; terms of the questions
CALLED = [(1, "r", 1, "openStore", 0), (1, "r", 1, "flush", 1), (1, "r", 1, "flush", 2), (1, "r", 1, "closeStore", 3), (1, "r", 1, "#hidden", 4), (2, "r", 1, "flush", 0), (2, "r", 1, "unknown", 1)]
CALLED_COLUMNS = "question_id BIGINT, repo STRING, file_id BIGINT, name STRING, pos INT"
MEANT = [(1, "openStore", 11), (1, "flush", 12), (1, "closeStore", 13), (1, "hidden", 14)]
MEANT_COLUMNS = "from_file BIGINT, name STRING, symbol_id BIGINT"
BEST = [(11, 201), (12, 202), (13, 201), (14, 203)]
BEST_COLUMNS = "symbol_id BIGINT, chunk_id BIGINT"
TERMS = [(1, "store"), (1, "open"), (2, "flush")]
TERM_COLUMNS = "question_id BIGINT, term STRING"
ON_SHOW = [(2, 202), (1, 299)]
ON_SHOW_COLUMNS = "question_id BIGINT, chunk_id BIGINT"


def _definitions(s, d):
    best = _frame(s, BEST, BEST_COLUMNS)
    return E.definition_candidates(
        _frame(s, CALLED, CALLED_COLUMNS), _frame(s, MEANT, MEANT_COLUMNS), best.select("symbol_id"), _frame(s, TERMS, TERM_COLUMNS), best, _frame(s, ON_SHOW, ON_SHOW_COLUMNS), 2
    )


# What users type and what it means; what clients send and what is kept of it.  The last columns are the expected results.
INPUTS = [
    ("acme/app", "acme/app"), (" https://github.com/acme/app ", "acme/app"), ("git@github.com:acme/app.git", "acme/app"), ("ssh://git@github.com/acme/app.git", "acme/app"),
    ("https://github.com/acme/app/blob/main/src/a.ts#L3", "acme/app"), ("github.com/acme/app?tab=readme", "acme/app"), ("git+https://www.github.com/acme/app.js", "acme/app.js"),
    ("acme", None), ("", None), (None, None), ("https://gitlab.com/acme/app", None), ("-acme/app", None),
]
REQUESTS = [
    ("https://github.com/acme/app", "application/json", "10.0.0.1, 192.0.2.7", "https://github.com/acme/app", True, "192.0.2.7"), ("http://github.com/acme", "application/vnd.api+json; charset=utf-8", "2001:db8::1", None, True, "2001:db8::1"),
    ("https://github.com.evil.example/", "text/plain", "unknown", None, False, None), (None, None, "", None, False, None), ("javascript:alert(1)", "application/jsonp", "a, <b>", None, False, None),
]


def _inputs(s, d):
    return _frame(s, [(i, x) for i, (x, _) in enumerate(INPUTS)], "n INT, typed STRING").select("n", P.repo_of_input(F.col("typed")).alias("repo"))


def _guards(s, d):
    r = _frame(s, [(i, *x[:3]) for i, x in enumerate(REQUESTS)], "n INT, url STRING, content_type STRING, forwarded STRING")
    return r.select("n", RQ.followed_link(F.col("url")).alias("link"), RQ.is_json(F.col("content_type")).alias("json"), RQ.client_key(F.col("forwarded")).alias("client"))


QUERIES = {"inputs_planted": _inputs, "guards_planted": _guards, "importer_blocks_planted": _importer_blocks, "definition_blocks_planted": _definitions, "imports_planted": _imports, "entries_planted": _entries, "importers_planted": _importers}


def _sql() -> dict[str, str]:
    from quarrykit.plans.graph import _ENTRIES, _RESOLVED, importers_sql

    files = cte("ingested_files", FILES, FILE_COLUMNS)
    asked = f"questions AS (SELECT *, NULL AS category, NULL AS expected, NULL AS absent_terms, NULL AS added_at FROM (WITH {cte('q_', QUESTIONS, QUESTION_COLUMNS)} SELECT * FROM q_))"
    found = importers_sql().rsplit("\nSELECT question_id", 1)
    tables = ", ".join(cte(n, r, c) for n, r, c in (("cl", CALLED, CALLED_COLUMNS), ("mt", MEANT, MEANT_COLUMNS), ("bs", BEST, BEST_COLUMNS), ("tm", TERMS, TERM_COLUMNS), ("sw", ON_SHOW, ON_SHOW_COLUMNS)))
    text = lambda v: str(v).upper() if isinstance(v, bool) else _literal(v)
    return {
        "inputs_planted": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(x[1])})" for i, x in enumerate(INPUTS)) + ") v(n, repo)",
        "guards_planted": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(text(v) for v in x[3:])})" for i, x in enumerate(REQUESTS)) + ") v(n, link, json, client)",
        "importer_blocks_planted": f"""WITH {files}, {asked}, {cte('ck', CHUNKS, CHUNK_COLUMNS)}, {cte('sw', SHOWN, SHOWN_COLUMNS)}, {found[0]}, im AS (SELECT question_id{found[1].replace("AS rank FROM", "AS rank, file_class FROM")}),
i1 AS (SELECT *, max(file_class = 'source') OVER (PARTITION BY question_id) AS any_ FROM im), i2 AS (SELECT * FROM i1 WHERE (NOT any_ OR file_class = 'source') AND NOT EXISTS (SELECT 1 FROM sw WHERE sw.question_id = i1.question_id AND sw.file_id = i1.file_id AND i1.line BETWEEN sw.start_line AND sw.end_line)),
i3 AS (SELECT question_id, chunk_id, min(rank) AS rank FROM i2 JOIN ck ON ck.file_id = i2.file_id AND line BETWEEN ck.start_line AND ck.end_line GROUP BY ALL) SELECT * FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, chunk_id) AS place FROM i3) WHERE place <= 2""",
        "definition_blocks_planted": f"""WITH {tables}, o AS (SELECT question_id, symbol_id, any_value(mt.name) AS name, count(*) AS calls, min(pos) AS pos FROM cl JOIN mt ON mt.from_file = cl.file_id AND mt.name = regexp_replace(cl.name, '^#', '') GROUP BY ALL),
sh AS (SELECT question_id, symbol_id, count(DISTINCT term) AS shared FROM (SELECT question_id, symbol_id, unnest(list_transform({D.split_identifier('name')}, lambda t_: {D.stem('t_')})) AS term FROM o) JOIN tm USING (question_id, term) GROUP BY ALL),
c AS (SELECT o.*, chunk_id, coalesce(shared, 0) AS shared FROM o LEFT JOIN sh USING (question_id, symbol_id) JOIN bs USING (symbol_id) WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.question_id = o.question_id AND sw.chunk_id = bs.chunk_id)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY shared DESC, calls DESC, pos, symbol_id) AS r FROM c) WHERE r = 1)
SELECT * FROM (SELECT question_id, chunk_id, symbol_id, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, calls DESC, pos, symbol_id) AS place FROM r) WHERE place <= 2""",
        "imports_planted": f"WITH {files}, {_RESOLVED} SELECT file_id, line, spec AS specifier, kind, target AS target_file_id, resolution FROM res",
        "entries_planted": f"WITH {files}, {_ENTRIES} SELECT file_id, dir, package, entry_kind, target, entry_file_id FROM en",
        "importers_planted": f"WITH {files}, questions AS (SELECT *, NULL AS category, NULL AS expected, NULL AS absent_terms, NULL AS added_at FROM (WITH {cte('q_', QUESTIONS, QUESTION_COLUMNS)} SELECT * FROM q_)), {importers_sql()}",
    }


SQL = _sql()
