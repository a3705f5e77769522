"""Problem 1: source files that do not parse.

Statements are parsed by recursive descent, expressions by precedence climbing, and a
syntax error is followed by panic-mode recovery, so that every error of a file is stored.

Defined results: null content counts as an empty file; an empty code file is valid, an empty
JSON file is not; a leading byte-order mark is valid; a null path or one of no checked
language gives no row; repeated rows give one row; nesting of any depth is parsed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.jsgrammar import FLOW, JS, TS, TSX, check, room_for
from quarrykit.session import spread

JSON, JSONC = "json", "jsonc"
LANGUAGE = {JS: "javascript", FLOW: "javascript", TS: "typescript", TSX: "tsx", JSON: "config", JSONC: "config"}
DIALECTS = (JS, FLOW, TS, TSX, JSON, JSONC)
CODE_PATH = r"\.(?:js|mjs|cjs|jsx|ts|tsx)$"
CHECKED_PATH = r"(?i)\.(?:js|mjs|cjs|jsx|ts|tsx)$|(?:^|/)(?:package|tsconfig[^/]*)\.json$"
_FIRST_COMMENT = re.compile(r"﻿?(?:#![^\n]*\n)?\s*(/\*[\s\S]*?\*/|(?://[^\n]*(?:\n[ \t]*|\Z))+)")
_JSON_TOKEN = re.compile(
    r"[ \t\r\n]*(?:([{}\[\]:,])|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9A-Fa-f]{4}))*\")"
    r"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null)\b|(\Z)|(.))",
    re.S,
)
_JSONC_SKIP = re.compile(r"(?:[ \t\r\n]|//[^\n]*|/\*[\s\S]*?\*/)*")


@lru_cache(maxsize=4096)
def _by_name(name: str) -> str | None:
    n = name.lower()
    if n.endswith(".tsx"):
        return TSX
    if n.endswith(".ts"):
        return TS
    if n.endswith((".js", ".mjs", ".cjs", ".jsx")):
        return JS
    if n == "package.json":
        return JSON
    if n.startswith("tsconfig") and n.endswith(".json"):
        return JSONC
    return None


def dialect_of(path: str | None, text: str) -> str | None:
    """The dialect that the file name, and for JavaScript the first comment, asks for."""
    if not path:
        return None
    d = _by_name(path.rsplit("/", 1)[-1])
    if d == JS and "@flow" in text:
        m = _FIRST_COMMENT.match(text)
        if m and re.search(r"@flow\b", m[1]):
            return FLOW
    return d


class _Fault(Exception):
    """A syntax error of a JSON text, already recorded."""


class _End(Exception):
    """The end of a JSON text within a value."""


def check_json(text: str, comments: bool) -> list[tuple[int, str]]:
    """All errors of a JSON text; ``comments`` also allows comments and trailing commas.

    Recursive descent; after an error the rest of the member is skipped up to the comma or bracket that ends it.
    """
    room_for(text)
    pos = 1 if text[:1] == "\ufeff" else 0
    errors: list[tuple[int, str]] = []
    kind, value, start = 0, "", 0

    def advance() -> None:
        nonlocal pos, kind, value, start
        if comments:
            pos = _JSONC_SKIP.match(text, pos).end()
        m = _JSON_TOKEN.match(text, pos)
        pos, kind, value, start = m.end(), m.lastindex, m[m.lastindex], m.start(m.lastindex)

    def fault() -> None:
        errors.append((start, "unexpected end of file" if kind == 5 else "malformed string" if value == '"' else f"unexpected {value[:20]!r}"))
        raise _End if kind == 5 else _Fault

    def skip_member() -> None:
        depth = 0
        while kind != 5:
            if kind == 1:
                if depth == 0 and value in ",]}":
                    return
                depth += (value in "{[") - (value in "}]")
            advance()
        raise _End

    def item() -> None:
        if kind == 1 and value == "{":
            container("}", member)
        elif kind == 1 and value == "[":
            container("]", item)
        elif kind in (2, 3, 4):
            advance()
        else:
            fault()

    def member() -> None:
        if kind != 2:
            fault()
        advance()
        if kind != 1 or value != ":":
            fault()
        advance()
        item()

    def container(closer: str, part) -> None:
        advance()
        first = True
        while not (kind == 1 and value == closer and (first or comments)):
            first = False
            try:
                part()
                if kind != 1 or value not in (",", closer):
                    fault()
            except _Fault:
                skip_member()
                if value != ",":
                    break
            if value == closer:
                break
            advance()
        advance()

    try:
        advance()
        item()
        if kind != 5:
            fault()
    except (_Fault, _End):
        pass
    return errors


def errors_of(text: str, dialect: str) -> list[tuple[int, str]]:
    if dialect in (JSON, JSONC):
        return check_json(text, dialect == JSONC)
    return check(text, dialect)


_CONFLICT = re.compile(r"[ \t]*(?:<{7}|={7}|>{7}|\|{7})(?:[ \t\r\n]|\Z)")


def first_cause(text: str, at: int, message: str) -> str:
    """Class of the first error.  A conflict marker counts only where the parser stumbles over it: on the line of the error or the one before."""
    line = text.rfind("\n", 0, at) + 1
    if _CONFLICT.match(text, line) or line and _CONFLICT.match(text, text.rfind("\n", 0, line - 1) + 1):
        return "merge-conflict"
    if "end of file" in message or "unterminated" in message:
        return "truncated"
    if re.match(r"diff --git |--- [ab]/|@@ -\d", text.lstrip("\ufeff \n")):
        return "patch"
    if at <= 64 and re.match(r"\s*(?:<!DOCTYPE|<html|<\?xml|#!/bin/|# |import \w+, |SELECT\b|\{|version\b|\d{3}:|Access )", text.lstrip("\ufeff"), re.I):
        return "other-language"
    if "outside" in message or message in ("unexpected '}'", "unexpected ')'", "unexpected 'case'"):
        return "missing-start"
    return "malformed"


def parse(path: str | None, text: str | None, acceptance: bool = True) -> dict | None:
    """Everything problem 1 stores of one file, or None if its language is not checked.

    accepted_by holds every dialect that the text is valid in; without ``acceptance`` only its own is tried.
    """
    text = text or ""
    d = dialect_of(path, text)
    if d is None:
        return None
    errors = errors_of(text, d)
    starts = None
    out = []
    for at, what in errors:
        if starts is None:
            starts = [0] + [m.end() for m in re.finditer("\n", text)]
        line = bisect_right(starts, at)
        out.append({"line": line, "col": at - starts[line - 1] + 1, "message": what})
    return {
        "dialect": d,
        "language": LANGUAGE[d],
        "status": "invalid" if errors else "valid",
        "errors": out,
        "first_cause": first_cause(text, *errors[0]) if errors else None,
        "accepted_by": [x for x in DIALECTS if (not errors if x == d else acceptance and not errors_of(text, x))],
    }


SCHEMA = (
    "file_id BIGINT, build_id BIGINT, repo STRING, path STRING, dialect STRING, language STRING, status STRING,"
    " errors ARRAY<STRUCT<line: INT, col: INT, message: STRING>>, first_cause STRING, accepted_by ARRAY<STRING>"
)


def _parse_batches(acceptance: bool):
    names = ["file_id", "build_id", "repo", "path", "dialect", "language", "status", "errors", "first_cause", "accepted_by"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, build, repo, path, text in zip(b.file_id, b.build_id, b.repo, b.path, b.content):
                if (p := parse(path, text, acceptance)) is not None:
                    rows.append((i, build, repo, path, p["dialect"], p["language"], p["status"], p["errors"], p["first_cause"], p["accepted_by"]))
            yield pd.DataFrame(rows, columns=names).astype({"file_id": "Int64", "build_id": "Int64"})

    return run


def _parsed(files: DataFrame, acceptance: bool) -> DataFrame:
    src = files.select("file_id", "build_id", "repo", "path", "content").where(F.col("path").rlike(CHECKED_PATH))
    return spread(src).mapInPandas(_parse_batches(acceptance), SCHEMA)


def parse_files(files: DataFrame) -> DataFrame:
    """One row per checked file with its status, all its errors, the first cause and every dialect that accepts it.

    files: file_id, build_id, repo, path, content; further columns are ignored.
    """
    return _parsed(files, True).dropDuplicates(["file_id"])


def invalid_files(files: DataFrame) -> DataFrame:
    return _parsed(files, False).where(F.col("status") == "invalid").select("file_id").distinct()


def rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their share for each repository and language, with the causes."""
    p = parse_files(files)
    bad = F.col("status") == "invalid"
    return p.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.count_if(bad).alias("invalid"),
        F.round(F.count_if(bad) / F.count("*"), 6).alias("invalid_share"),
        F.count_if(bad & (F.col("first_cause") == "truncated")).alias("truncated"),
        F.count_if(bad & (F.col("first_cause") == "merge-conflict")).alias("merge_conflicts"),
        F.count_if(bad & (F.size("accepted_by") > 0)).alias("valid_in_other_language"),
    )


def against_reports(files: DataFrame, indexes: DataFrame) -> DataFrame:
    """What the indexing runs reported of JavaScript files against what the parser finds, for each build."""
    p = _parsed(files.where(F.col("path").rlike(r"(?i)\.(?:js|mjs|cjs|jsx)$")), False).select("file_id", "build_id", "status").dropDuplicates(["file_id"])
    seen = p.groupBy("build_id").agg(F.count("*").alias("js_measured"), F.count_if(F.col("status") == "invalid").alias("errors_measured"))
    told = indexes.dropDuplicates(["build_id"]).select("build_id", "repo", F.col("js_files").alias("js_reported"), F.col("with_errors").alias("errors_reported"))
    return told.join(seen, "build_id", "left").fillna(0, ["js_measured", "errors_measured"])
