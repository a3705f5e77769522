"""Symbols, imports, exports and chunk units of source files from a token scan.

The scan knows strings, comments, templates, regular expressions and bracket depth; it cuts a
file into top-level statements and reads the head of each.  It is no parser: a file whose brackets
do not balance gets status "fallback" with a reason and fixed line windows.

Defined results: null content counts as empty; an empty file has status "ast" and no rows; a file of
a language without a scanner has status "text" and windows; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit import config as C
from quarrykit.functions import paths as P
from quarrykit.session import spread

_SCAN = re.compile(
    r"(?P<skip>[^\S\n]+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<nl>\n)|(?P<word>[A-Za-z_$#][\w$]*)|(?P<num>\.?\d[\w.]*)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<tick>`)|(?P<punc>=>|\.\.\.|\?\.|[^\w\s])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => + - * % < > ~ ^".split()) | {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}
_OPEN, _CLOSE = "([{", ")]}"
_CONTINUES = frozenset(". , = + - * / % & | ^ ? : < > => ( [ ?. && || instanceof in of extends implements as".split())
_STARTS = frozenset(
    "import export function class const let var async interface type enum declare abstract namespace module if for while do switch try throw return break continue label describe it test".split()
)


class Unbalanced(Exception):
    pass


@dataclass
class Token:
    text: str
    kind: str
    line: int
    first_on_line: bool


@dataclass
class Found:
    symbols: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    exports: list = field(default_factory=list)
    units: list = field(default_factory=list)


def _template_end(text: str, pos: int) -> int:
    """Place after the template literal that opens at pos."""
    i, n = pos + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            return i + 1
        if c == "$" and text[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                if text[i] in "\"'":
                    m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(text, i)
                    i = m.end() if m else i + 1
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
            continue
        i += 1
    raise Unbalanced("unterminated template")


def scan(text: str, jsx: bool) -> list[Token]:
    out: list[Token] = []
    pos, line, fresh, n = 0, 1, True, len(text)
    while pos < n:
        m = _SCAN.match(text, pos)
        k, s = m.lastgroup, m[0]
        if k == "nl":
            line, fresh = line + 1, True
        elif k == "skip":
            line += s.count("\n")
        else:
            end = m.end()
            if k == "tick":
                end = _template_end(text, pos)
                k = "str"
            elif s == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (r := _REGEX.match(text, pos)):
                end, k = r.end(), "str"
            s = text[pos:end]
            if s and s[0] in "\"'" and k == "punc" and not jsx:
                raise Unbalanced("unterminated string")
            out.append(Token(s, k, line, fresh))
            fresh = False
            line += s.count("\n")
            pos = end
            continue
        pos = m.end()
    return out


def _closing(toks: list[Token]) -> list[int]:
    """For each opening bracket the place of its closing one; -1 elsewhere."""
    out, stack = [-1] * len(toks), []
    for i, t in enumerate(toks):
        if t.kind == "punc" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "punc" and t.text in _CLOSE:
            if not stack or _OPEN.index(toks[stack[-1]].text) != _CLOSE.index(t.text):
                raise Unbalanced("brackets do not balance")
            out[stack.pop()] = i
    if stack:
        raise Unbalanced("brackets do not balance")
    return out


def _statements(toks: list[Token], close: list[int], a: int, b: int) -> list[tuple[int, int]]:
    """Statements (first and last token) of toks[a:b] at one depth."""
    out, i, start = [], a, None
    while i < b:
        t = toks[i]
        if start is None:
            if t.text == ";":
                i += 1
                continue
            start = i
        elif t.first_on_line and toks[i - 1].text not in _CONTINUES and t.text not in _CONTINUES and (t.text in _STARTS or t.text == "@" or t.kind == "word" and toks[i - 1].text in ("}", ")", "]")) and t.text not in ("else", "catch", "finally", "while", "from"):
            out.append((start, i - 1))
            start = i
        if close[i] >= 0:
            j = close[i]
            head = {x.text for x in toks[start:i] if x.kind == "word"}
            i = j + 1
            nxt = toks[i].text if i < b else ""
            if t.text == "{" and nxt not in ("else", "catch", "finally", "while") and (head & {"class", "interface", "enum", "namespace", "module", "if", "for", "while", "switch", "try", "else", "finally", "catch", "do"} or "function" in head and not {"const", "let", "var"} & head and "=" not in {x.text for x in toks[start:j] if x.kind == "punc"} - {"=>"}):
                if nxt not in _CONTINUES and nxt != ";" or "export" not in head:
                    out.append((start, j))
                    start = None
            continue
        if t.text == ";":
            out.append((start, i))
            start = None
        i += 1
    if start is not None:
        out.append((start, b - 1))
    return out


def _clause_names(toks: list[Token], a: int, b: int, exported: bool) -> list[str]:
    """Names of a clause {a, b as c}: original names, or the names given."""
    out, part = [], []
    for t in [*toks[a + 1 : b], Token(",", "punc", 0, False)]:
        if t.text == ",":
            ws = [x.text for x in part if x.text != "type" or len(part) == 1]
            if ws:
                out.append(ws[-1] if exported else ws[0])
            part = []
        else:
            part.append(t)
    return out


def extract(text: str, jsx: bool = False) -> Found:
    """Symbols, imports, exports and units of one file; raises ``Unbalanced``."""
    toks = scan(text, jsx)
    close = _closing(toks)
    f = Found()
    for a, b in _statements(toks, close, 0, len(toks)):
        first, last = toks[a].line, toks[b].line + toks[b].text.count("\n")
        _units(f, toks, close, a, b, first, last)
        _statement(f, toks, close, a, b, first, last)
    for i, t in enumerate(toks[:-2]):
        if t.text in ("require", "import") and t.kind == "word" and toks[i + 1].text == "(" and toks[i + 2].kind == "str" and (i == 0 or toks[i - 1].text != "."):
            f.imports.append((toks[i + 2].text[1:-1], "require" if t.text == "require" else "dynamic", [], t.line))
    return f


def _units(f: Found, toks, close, a, b, first, last) -> None:
    if last - first + 1 <= C.MAX_CHUNK_LINES:
        f.units.append((first, last))
        return
    body = next((i for i in range(a, b) if toks[i].text == "{" and any(t.text == "class" for t in toks[a:i])), None)
    members = _members(toks, close, body) if body is not None else []
    if not members:
        f.units += [(s, min(last, s + C.WINDOW_LINES - 1)) for s in range(first, last + 1, C.WINDOW_LINES)]
        return
    if members[0][2] > first:
        f.units.append((first, members[0][2] - 1))
    for _, _, x, y in members:
        f.units += [(x, y)] if y - x + 1 <= C.MAX_CHUNK_LINES else [(s, min(y, s + C.WINDOW_LINES - 1)) for s in range(x, y + 1, C.WINDOW_LINES)]


_MEMBER_WORDS = frozenset("static async get set public private protected readonly abstract override declare accessor".split())


def _members(toks: list[Token], close: list[int], body: int) -> list[tuple[str, bool, int, int]]:
    """(name, whether it can be called, first and last line) of the members of a class body."""
    out, i, end = [], body + 1, close[body]
    while i < end:
        if toks[i].text in (";", ","):
            i += 1
            continue
        start = i
        while i < end and (toks[i].text in _MEMBER_WORDS and toks[i + 1].text not in ("(", "=", ";", ":", "}") or toks[i].text == "*"):
            i += 1
        if toks[i].text == "@":
            i += 2
            if close[i] >= 0:
                i = close[i] + 1
            continue
        name = toks[i].text.strip("\"'") if toks[i].kind in ("word", "str", "num") else None
        i = close[i] + 1 if close[i] >= 0 else i + 1
        method, done = False, False
        while i < end and not done:
            t = toks[i]
            if t.text == "(":
                method = method or not any(x.text in ("=", ":") for x in toks[start + 1 : i])
                i = close[i] + 1
                continue
            if t.text == "{" and method:
                i = close[i] + 1
                done = True
                continue
            if t.text == "=>" and any(x.text == "=" for x in toks[start:i]):
                method = True
                if toks[i + 1].text == "{":
                    i = close[i + 1] + 1
                    done = True
                    continue
            if t.text == "function" and any(x.text == "=" for x in toks[start:i]):
                method = True
            if t.text == ";":
                i += 1
                done = True
                continue
            if t.first_on_line and i > start and toks[i - 1].text not in _CONTINUES and t.text not in _CONTINUES and t.text not in ("{", ")", "]"):
                done = True
                continue
            i = close[i] + 1 if close[i] >= 0 else i + 1
        stop = max(start, min(i, end) - 1)
        if name:
            out.append((name, method, toks[start].line, toks[stop].line + toks[stop].text.count("\n")))
    return out


def _statement(f: Found, toks, close, a, b, first, last) -> None:
    i, exported, default = a, False, False
    while toks[i].text == "@" and i + 1 < b:
        i += 2
        if close[i] >= 0:
            i = close[i] + 1
    word = toks[i].text
    if word == "import" and toks[min(i + 1, b)].text not in ("(", "."):
        spec = next((t.text[1:-1] for t in toks[i : b + 1] if t.kind == "str"), None)
        if spec is not None:
            names = []
            for j in range(i + 1, b + 1):
                if toks[j].text == "{":
                    names += _clause_names(toks, j, close[j], False)
                    break
                if toks[j].text == "*":
                    names.append("*")
                elif toks[j].kind == "word" and toks[j].text not in ("type", "typeof", "from", "as") and toks[j - 1].text in ("import", "type"):
                    names.append("default")
            f.imports.append((spec, "esm", names, first))
        return
    if word == "export":
        exported = True
        i += 1
        if i <= b and toks[i].text == "default":
            default = True
            f.exports.append(("default", first))
            i += 1
        if i > b:
            return
        if toks[i].text in ("{", "*") or toks[i].text == "type" and toks[min(i + 1, b)].text in ("{", "*"):
            i += toks[i].text == "type"
            names = []
            if toks[i].text == "{":
                f.exports += [(n, first) for n in _clause_names(toks, i, close[i], True)]
                names = _clause_names(toks, i, close[i], False)
                rest = toks[close[i] + 1 : b + 1]
            else:
                ns = toks[i + 2].text if toks[min(i + 1, b)].text == "as" else "*"
                f.exports.append((ns, first))
                names, rest = ["*"], toks[i + 1 : b + 1]
            spec = next((t.text[1:-1] for t in rest if t.kind == "str"), None)
            if spec is not None and any(t.text == "from" for t in rest):
                f.imports.append((spec, "reexport", names, first))
            return
    while i < b and toks[i].text in ("declare", "abstract", "async") and toks[i + 1].kind == "word":
        i += 1

    def add(name, kind, **more):
        f.symbols.append({"name": name, "qualified_name": name, "kind": kind, "start_line": first, "end_line": last, "exported": exported, "parent": None} | more)
        if exported and not default and not more.get("parent"):
            f.exports.append((name, first))

    word = toks[i].text
    if word == "function":
        j = i + 1 + (toks[min(i + 1, b)].text == "*")
        if j <= b and toks[j].kind == "word":
            add(toks[j].text, "function")
    elif word == "class":
        name = toks[i + 1].text if toks[min(i + 1, b)].kind == "word" and toks[i + 1].text not in ("extends", "implements") else None
        if name:
            add(name, "class")
        body = next((j for j in range(i, b + 1) if toks[j].text == "{"), None)
        if body is not None:
            for n, method, x, y in _members(toks, close, body):
                if method:
                    f.symbols.append({"name": n, "qualified_name": f"{name}.{n}" if name else n, "kind": "method", "start_line": x, "end_line": y, "exported": exported, "parent": name})
    elif word in ("interface", "enum") or word == "type" and toks[min(i + 1, b)].kind == "word":
        add(toks[i + 1].text, word)
    elif word in ("const", "let", "var"):
        if toks[min(i + 1, b)].text == "enum":
            add(toks[i + 2].text, "enum")
            return
        j, depth_start = i + 1, True
        while j <= b:
            t = toks[j]
            if depth_start and t.kind == "word":
                k, value = j + 1, None
                while k <= b and toks[k].text not in ("=", ",", ";"):
                    k = close[k] + 1 if close[k] >= 0 else k + 1
                if k <= b and toks[k].text == "=":
                    value = k + 1
                fn = False
                if value is not None and value <= b:
                    v = value + (toks[value].text == "async" and value < b)
                    fn = toks[v].text in ("function", "class") or toks[v].kind == "word" and toks[min(v + 1, b)].text == "=>"
                    if toks[v].text == "(":
                        z = close[v] + 1
                        while z <= b and toks[z].text not in ("=>", ",", ";", "{") and toks[z].text not in ("+", "-", ".", "?", "&", "|", "*"):
                            z = close[z] + 1 if close[z] >= 0 else z + 1
                        fn = z <= b and toks[z].text == "=>"
                add(t.text, "function" if fn else "variable")
            depth_start = False
            if close[j] >= 0:
                j = close[j]
            elif t.text == ",":
                depth_start = True
            j += 1
    elif toks[i].kind == "word" and not exported:
        left = []
        j = i
        while j <= b and (toks[j].kind == "word" or toks[j].text == "."):
            left.append(toks[j].text)
            j += 1
        if j < b and toks[j].text == "=" and len(left) >= 3:
            path, v = "".join(left), j + 1 + (toks[j + 1].text == "async")
            fn = v <= b and (toks[v].text in ("function", "class") or toks[v].text == "(" and any(t.text == "=>" for t in toks[close[v] : close[v] + 2]) or toks[v].kind == "word" and toks[min(v + 1, b)].text == "=>")
            if path == "module.exports":
                f.exports.append(("default", first))
                if toks[v].text == "{":
                    f.exports += [(n, first) for n in _clause_names(toks, v, close[v], False) if re.fullmatch(r"[A-Za-z_$][\w$]*", n)]
            elif m := re.fullmatch(r"(?:module\.)?exports\.([A-Za-z_$][\w$]*)", path):
                f.exports.append((m[1], first))
                if fn:
                    add(m[1], "function", qualified_name=path)
            elif fn:
                add(left[-1], "class" if toks[v].text == "class" else "function", qualified_name=path)


def merged_chunks(units: list[tuple[int, int]], lines: int) -> list[tuple[int, int]]:
    """The chunks of ``index.merge_units``, for one file."""
    if lines <= 0:
        return []
    out: list[list[int]] = []
    for a, b in sorted(units):
        if out and (out[-1][1] - out[-1][0] + 1 < C.MIN_CHUNK_LINES and b - out[-1][0] + 1 <= C.MAX_CHUNK_LINES or a <= out[-1][1]):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    if not out:
        return [(s, min(lines, s + C.WINDOW_LINES - 1)) for s in range(1, lines + 1, C.WINDOW_LINES)]
    cover, nxt = [], 1
    for k, (_, b) in enumerate(out):
        e = lines if k == len(out) - 1 else min(lines, b)
        if e >= nxt:
            cover.append((nxt, e))
            nxt = e + 1
    return cover


ROW = (
    "file_id BIGINT, repo STRING, sha STRING, path STRING, language STRING, status STRING, reason STRING, line_count INT,"
    " symbols ARRAY<STRUCT<name: STRING, qualified_name: STRING, kind: STRING, start_line: INT, end_line: INT, exported: BOOLEAN, parent: STRING>>,"
    " imports ARRAY<STRUCT<specifier: STRING, kind: STRING, names: ARRAY<STRING>, line: INT>>, exports ARRAY<STRUCT<name: STRING, line: INT>>, chunks ARRAY<STRUCT<start_line: INT, end_line: INT>>"
)


def extracted(ingested: DataFrame) -> DataFrame:
    """One row per file with everything the scan finds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in re.split(r", (?=[a-z_]+ [A-Z])", ROW)]
        for b in batches:
            rows = []
            for i, repo, sha, path, language, text in zip(b.file_id, b.repo, b.sha, b.path, b.language, b.content):
                n = (text.count("\n") + (not text.endswith("\n"))) if text else 0
                status, reason, f = "text", None, Found()
                if language in ("javascript", "typescript", "tsx"):
                    try:
                        f, status = extract(text, language != "typescript"), "ast"
                    except Unbalanced as e:
                        status, reason = "fallback", str(e)
                    except (IndexError, RecursionError):
                        status, reason, f = "fallback", "scan failed", Found()
                rows.append((i, repo, sha, path, language, status, reason, n, f.symbols,
                             [dict(zip(("specifier", "kind", "names", "line"), x)) for x in f.imports], [dict(zip(("name", "line"), x)) for x in f.exports],
                             [{"start_line": x, "end_line": y} for x, y in merged_chunks(f.units, n)]))
            yield pd.DataFrame(rows, columns=names)

    src = ingested.select("file_id", "repo", "sha", "path", P.language_of(F.col("path")).alias("language"), F.regexp_replace(F.coalesce("content", F.lit("")), "^\\x{FEFF}", "").alias("content"))
    return spread(src, "file_id").dropDuplicates(["file_id"]).mapInPandas(run, ROW)


def status_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("language", "status").agg(F.count("*").alias("files"))


def symbol_rows(e: DataFrame) -> DataFrame:
    return e.select("file_id", "repo", F.explode("symbols").alias("s")).select("file_id", "repo", "s.*")


def chunk_rows(e: DataFrame) -> DataFrame:
    return e.select("file_id", "repo", F.explode("chunks").alias("c")).select("file_id", "repo", "c.*")
