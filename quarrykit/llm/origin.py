"""Evidence that a source file was not written by hand in its repository.

``evidence`` looks at one file: its path, its leading comment, its layout and the make-up of
its tokens.  ``fingerprints`` winnows the token stream so that copies of a file, changed or
not, can be recognised across repositories.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[^\s\w]"
)
_HEAD = re.compile(r"﻿?(?:#![^\n]*\n)?\s*((?:/\*[\s\S]*?\*/\s*|//[^\n]*(?:\n\s*|\Z))+)")

# What generators say of their output in a leading comment.
_GENERATED = re.compile(
    r"(?im)^[\s/*!#]*(?:<auto-?generated\b|@generated\b|auto-?generated\b(?: (?:file|from|by|code)|[.:;,]|\s*$)"
    r"|(?:this (?:file|code|module|client|class|schema) (?:is|was|has been) |code |file )?(?:automatically |auto-?|machine[- ])(?:generated|made|written|produced)\b"
    r"|(?:this (?:file|code|module|client|class|schema) (?:is|was|has been) |code |file )?(?:generated|produced|emitted|written|created|compiled) (?:by|from|with|using) "
    r"|note:? machine[- ]made)"
)
_NO_EDIT = re.compile(
    r"(?i)\bdo not (?:edit|modify|change|touch)\b|\bdon'?t (?:edit|modify) (?:this|by hand)|never (?:by hand|edit)|hand[- ]edits? do(?:es)? not|manual (?:edits|changes) will be|"
    r"changes (?:to this file )?will be (?:lost|overwritten)|please edit \S+ instead|will be overwritten|edits? (?:here )?(?:are|will be) lost|not edit(?:ed)? by hand"
)
_OUTPUT = re.compile(
    r"(?i)^[/*!\s]*(?:end of (?:generated |tool |compiler )?(?:output|code|file)\b.*\b(?:of|by|from)\b|[\w.-]+: \d+ (?:lines?|symbols?|files?|bytes) (?:emitted|generated|written|produced)"
    r"|(?:auto-?)?(?:generated|emitted|produced|wrote) \d+ \w+ (?:from|by|with)\b|(?:auto-?)?generated (?:by|from)\b)|\bdo not edit\b"
)
_TALK = re.compile(r"(?i)\b(?:whose|which|that|says?|when|every file|skip|files? (?:with|marked)|if the|look for|detect)\b")
# Marks left by bundlers and compilers in code.
_COMPILED = re.compile(
    r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|var __(?:importDefault|importStar|awaiter|generator|extends|assign|rest|createBinding|decorate|spreadArray) = "
    r"|(?:^|\n)//[#@] sourceMappingURL=|_interopRequire(?:Default|Wildcard)\(|(?:^|\n)var _[a-z]\w* = _?require\(|__toESM\(|__commonJS\(|__export\(\w+, \{"
)
_BUNDLE = re.compile(
    r"__webpack_(?:require|modules|exports)|/\*{3}/ |__module_loader__|\(function ?\((?:modules|e|t|n)(?:, ?\w)*\) ?\{\s*(?:var|const|let) installed|parcelRequire|System\.register\(\["
    r"|typeof define ?={2,3} ?[\"']function[\"'] ?&& ?define\.amd|webpackJsonp|webpackChunk"
)
_PKG_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|\.yarn|third_party|third-party|3rdparty)/")
_VENDOR_PATH = re.compile(r"(?:^|/)(?:vendor|external|externals|extern|deps|contrib)/")
_MIN_NAME = re.compile(r"[.-](?:min|bundle|prod|pack|umd|iife)\.(?:m|c)?jsx?$", re.I)
_GEN_PATH = re.compile(r"(?:^|/)(?:gen|__generated__|generated|codegen|autogen)/|[._](?:pb|pb2|generated|g|gen)\.(?:[jt]sx?|mjs|cjs)$|_pb\.(?:[jt]s)$")
_LICENCE = r"(?:MIT|ISC|BSD(?:-\d-Clause)?|Apache(?:-2\.0| 2\.0)?|MPL(?:-2\.0)?|GPL(?:v?\d)?|LGPL|Unlicense|WTFPL|Zlib|CC0(?:-1\.0)?|0BSD)"
_VERSION = r"v?\d+\.\d+\.\d+(?:[-+.][\w.]+)?"
_BANNER = re.compile(
    rf"(?i)[\w.@/-]{{2,60}}[ @]+{_VERSION}\s*(?:[|(,*/-]|\n)|@license\s+[\w.@/-]+\s+{_VERSION}|copied (?:unchanged |verbatim )?from\s+\S+\s+{_VERSION}"
    rf"|\|\s*{_LICENCE}\b|released under the {_LICENCE}"
)


def tokens(text: str) -> list[str]:
    """All tokens but comments."""
    found = _TOKEN.findall(text)
    if "//" in text or "/*" in text:
        return [t for t in found if t[:2] != "//" and t[:2] != "/*"]
    return found


WORD, NUMBER, STRING, OTHER = 1, 2, 3, 4
_KIND = {c: NUMBER for c in "0123456789"} | {c: STRING for c in "\"'`"}


def kind_of(t: str) -> int:
    c = t[0]
    if k := _KIND.get(c):
        return k if k == NUMBER or len(t) > 1 else OTHER
    return WORD if c.isalpha() or c in "_$" else OTHER


_hash: dict[str, int] = {}
_shape: dict[str, str] = {}


def _hashed(t: str) -> int:
    h = _hash.get(t)
    if h is None:
        h = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
        if len(t) <= 40:
            if len(_hash) >= 200_000:
                _hash.clear()
            _hash[t] = h
    return h


def _shaped(t: str) -> str:
    """One character for the shape of a token: keywords by their first letter, punctuation as it is."""
    c = _shape.get(t)
    if c is None:
        k = kind_of(t)
        c = t[0] if k == OTHER or t in _KEYWORDS else "WNSO"[k - 1]
        if len(t) <= 40:
            if len(_shape) >= 200_000:
                _shape.clear()
            _shape[t] = c
    return c


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    n = len(h) - k + 1
    roll = np.zeros(n, np.uint64)
    for j in range(k):
        roll = roll * _BASE + h[j : j + n]
    roll ^= roll >> np.uint64(29)
    roll *= _MIX
    return roll


def fingerprints(toks: list[str], k: int = 20, w: int = 24) -> list[int]:
    """Winnowed 64-bit fingerprints of all runs of k tokens (strings and numbers by their text).

    Of every w successive runs at least one is kept, so two files that share k + w - 1
    tokens in a row share a fingerprint.  A text shorter than k tokens has none.
    """
    if len(toks) < k:
        return []
    roll = _rolled(np.fromiter(map(_hashed, toks), np.uint64, len(toks)), k)
    w = min(w, len(roll))
    return np.unique(np.lib.stride_tricks.sliding_window_view(roll, w).min(axis=1)).view(np.int64).tolist()


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _repetition(toks: list[str], k: int = 12) -> tuple[int, float]:
    """Number of token shapes (runs of k kinds) and the share of distinct ones."""
    n = len(toks) - k + 1
    if n < 150:
        return max(0, n), 1.0
    shapes = np.frombuffer("".join(map(_shaped, toks)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return n, len(np.unique(_rolled(shapes, k))) / n


_JS_START = re.compile(r"(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/|\ufeff|[\"']use strict[\"'];?)*(?:export|const|let|var|function|class|exports|module|async|Object|import|\(|!)")
_KEYWORDS = frozenset("const let var function return if else for while switch case break export import class new try catch throw async await".split())


def head_comment(text: str) -> str:
    m = _HEAD.match(text)
    return m[1] if m else ""


def tail_comment(text: str) -> str:
    """The comment on lines of its own that ends a text."""
    end = text.rstrip()
    if end.endswith("*/"):
        at = end.rfind("/*")
    else:
        at = end.find("//", end.rfind("\n") + 1)
    return end[at:] if at >= 0 and not end[end.rfind("\n", 0, at) + 1 : at].strip() else ""


def claims(path: str, text: str) -> list[str]:
    """What path and leading comment say of a file's being another's work.  It supports the verdict of the
    fingerprints and stands in for it only where a file has no counterpart to be compared with."""
    out = []
    if _PKG_PATH.search(path):
        out.append("package-path")
    head = head_comment(text)
    if head and _BANNER.search(head) and not re.search(r"(?i)LICENSE file of this repository", head):
        out.append("library-banner")
    if _VENDOR_PATH.search(path) and not _IMPORTS.search(text):
        out.append("vendor-path")
    return out


def evidence(path: str, text: str, toks: list[str]) -> list[str]:
    """Reasons from the file itself to take it for output of a tool or data, in a fixed order."""
    out = []
    head = head_comment(text)
    if head:
        talk = _TALK.search(head)
        if (_GENERATED.search(head) and (not talk or _NO_EDIT.search(head))) or (_NO_EDIT.search(head) and not talk):
            out.append("generated-header")
    if (tail := tail_comment(text)) and _OUTPUT.search(tail) and not _TALK.search(tail):
        out.append("generated-trailer")
    if _COMPILED.search(text):
        out.append("compiled")
    if _BUNDLE.search(text):
        out.append("bundle")
    n = len(text)
    counted = Counter(toks)
    words = names = short = code = strings = numbers = flow = symbols = 0
    for t, c in counted.items():
        k = kind_of(t)
        size = len(t) * c
        code += size
        if k == WORD:
            words += c
            if t in _KEYWORDS:
                flow += c
            else:
                names += c
                if len(t) <= 3:
                    short += c
        elif k == STRING:
            strings += size
        else:
            symbols += size
            numbers += c if k == NUMBER else 0
    if n >= 200 and words:
        lines = text.count("\n") + 1
        if words >= 25 and short >= 0.55 * max(1, names) and strings < 0.6 * code:
            blank = (text.count(" ") + text.count("\t") + text.count("\r") + lines - 1) / n
            if blank <= 0.10 and (n / lines >= 60 or max(map(len, text.split("\n"))) >= 200):
                out.append("minified")
        if len(toks) >= 3 and (strings + symbols) >= 0.9 * code and flow - 2 <= 1 and (strings >= 1000 or numbers >= 60 or (len(toks) >= 150 and strings + numbers > 0)):
            if _LITERAL_MODULE.match(text):
                out.append("data")
    imports = _IMPORTS.search(text)
    if not imports and "data" not in out and "minified" not in out:
        shapes, distinct = _repetition(toks)
        if shapes >= 150 and distinct <= 0.16 and _JS_START.match(text[len(head) :] if text.startswith(head) else text):
            out.append("repetitive")
    if _GEN_PATH.search(path) and words and not imports:
        out.append("generated-path")
    return out


_IMPORTS = re.compile(r"(?m)^\s*(?:import\b|(?:const|var|let) .*= require\()")
_LITERAL_MODULE = re.compile(
    r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/|\ufeff|[\"']use strict[\"'];?)*(?:export\s+default\b|module\.exports\s*=|export\s+const\s+\w+(?:\s*:\s*[^=]+)?\s*=|exports\.\w+\s*=)"
)
