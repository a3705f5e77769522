"""Find credentials in source text and mask them.

One text is scanned in layers.  The plain layer holds the text itself with adjacent string
pieces joined; every literal that decodes (base64, hex, percent, backslash escapes) opens a
further layer, which is scanned in the same way and maps back to the enclosing literal.
Private-key containers are recognised by their binary grammar (DER, OpenSSH), not by a name.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from urllib.parse import unquote_to_bytes

MAX_DEPTH = 4

# Words that say a name holds a credential, and values that never are one.
_LAST_WORD = frozenset(
    "password passwd pwd pass passphrase secret secrets token tokens credential credentials apikey auth authorization pat passcode pw".split()
)
_KEY_LEAD = frozenset("api access private secret client signing encryption auth session service account storage master".split())
_PLACEHOLDER = re.compile(
    r"(?i)change.?me|your[_ -]|replace|redacted|placeholder|example|dummy|sample|todo|fixme|insert|xxxx|\*\*\*|\.\.\.|<[^>]*>|\$\{|\{\{|%\(|"
    r"\$\(|\$[A-Z_]+\b|^(?:none|null|undefined|true|false|test|admin|root|user|bearer|basic|masked|hidden)$|process\.env|os\.environ|vault|^\$"
)
_NOT_SECRET = re.compile(
    r"(?i)^(?:sha(?:1|224|256|384|512)[-:]|data:|md5[-:]|https?://|git\+|file:|\.{0,2}/|@)|"
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^\^|-----BEGIN (?:RSA )?PUBLIC"
)
_PREFIXED = (
    r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{30,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|xox[abeprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|[a-z]{2,6}_(?:pat|prod|live|sec|secret|tok|token|key|sk|api)_[A-Za-z0-9]{16,}"
)
_PREFIX_RE = re.compile(rf"(?<![A-Za-z0-9_+/-])(?:{_PREFIXED})")
_PEM = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\r?\n|\\r\\n|\\n|\\\\n|[ \t\"'+,;#/*>|])*"
    r"((?:(?:[A-Za-z0-9-]+: [^\n\\]*|[A-Za-z0-9+/=]+)(?:\r?\n|\\r\\n|\\n|\\\\n|[ \t\"'+,;#/*>|])*)+?)"
    r"(?=-----END|\Z|[^A-Za-z0-9+/=\s\\])"
)
_B64RUN = re.compile(r"[A-Za-z0-9+/]{24,}")
_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]{1,15}://([^\s:/@\"'`<>{}]*):([^\s@\"'`<>/]{3,})@[A-Za-z0-9_.\[\]-]")
_QUERY = re.compile(r"[?&]([A-Za-z0-9_.-]{2,})=([^\s&\"'`<>#]{6,})")
_HEADER = re.compile(r"(?i)\b(bearer|basic|token)[ \t]+([A-Za-z0-9+/_.=~-]{8,})")
_ASSIGN = re.compile(
    r"(?<![\w$.-])[\"'`]?(-{0,2}[A-Za-z_$][\w$.-]*?)[\"'`]?[\"'`\])]?[ \t]*(?::[ \t]*(?:string|any)[ \t]*)?"
    r"(?:\|\|=|\?\?=|=>|:=|=(?![=>])|:(?!:)|\|\||\?\?)[ \t]*(?:await[ \t]+)?([\"'`]?)"
)
_ENV_DEFAULT = re.compile(r"(?:process\.env|import\.meta\.env|os\.environ|env)(?:\.|\[[\"'])([A-Za-z_][A-Za-z0-9_]*)(?:[\"']\])?[ \t]*(?:\|\||\?\?)[ \t]*([\"'`])")
_ARGV = re.compile(r"(?<![\w-])(--?[A-Za-z][A-Za-z0-9_-]*)(?:[\"'`][ \t]*,[ \t]*[\"'`]|[ \t]+[\"']?|=[\"']?)([^\s\"'`,\]]{3,})")
_USERPASS = re.compile(r"(?<![\w-])(?:-u|--user|--userpwd|--basic)(?:[\"'`][ \t]*,[ \t]*[\"'`]|[ \t]+[\"']?|=[\"']?)([^\s\"'`:,]+):([^\s\"'`,]{4,})")
_HEADER_NAME = re.compile(r"(?i)(?<![\w-])((?:x-)[a-z0-9-]{2,}|authorization|proxy-authorization|cookie|api-key)[\"'`]?[ \t]*[:=][ \t]*[\"'`]?([^\s\"'`,;}]{8,})")
_PROSE = re.compile(
    r"(?i)(?:\b(?:log[ -]?in|sign[ -]?in|password|passwd|pwd|passphrase|credentials?|creds|account|token|secret|api key|pw)\b)[^:=\n\"'`]{0,60}(?:[:=]|\bis\b)[ \t]*"
    r"(?:[\w.@-]{2,40}[ \t]*[/|,][ \t]*)?[\"'`]?([^\s\"'`,;)]{8,})"
)
_RANDOM_ARG = re.compile(r"[(,][ \t]*[\"'`]([A-Za-z0-9]{32,64})[\"'`][ \t]*[,)]")
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`", re.S)
_ARRAY_JOIN = re.compile(r"\[((?:\s*(?:\"[^\"\n\\]*\"|'[^'\n\\]*')\s*,?)+)\]\s*\.join\(\s*(?:\"\"|''|``)\s*\)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_-]{16,}={0,2})(?![A-Za-z0-9+/=_-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:0x)?((?:[0-9a-fA-F]{2}){12,})(?![A-Za-z0-9])")
_PCT = re.compile(r"[A-Za-z0-9_.~+-]*(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~+-]*){3,}")
_ESC1 = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]+)\}|\\([0-7]{3})")
#: Something of this stands in every line that holds a credential; found by plain search in lower case.
_HINT_WORDS = (
    "pass", "secret", "token", "key", "auth", "cred", "bearer", "basic", "pwd", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "_live_", "_pat_", "_prod_", "_sec_", "_tok_", "_sk_",
    "_api_", "akia", "asia", "xox", "eyj", "aiza", "sg.", "-u ", "-u\"", "-u'", "--user", "login", "log in", "log-in", "sign in", "sign-in", "signin", "x-", "sig=", "code=",
)
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{24}")
_URL_HINT = re.compile(r"://[^\s/@]+@")
_ENC_HINT = re.compile(r"%[0-9A-Fa-f]{2}[^%\n]{0,9}%[0-9A-Fa-f]{2}|\\x[0-9a-fA-F]{2}|\\u|\\[0-7]{3}")


def hints(s: str) -> list[int]:
    """Places of everything that can begin a finding, in no order, at least one for each line concerned."""
    low = s.lower()
    if len(low) != len(s):
        low = "".join(c.lower() if c < "\x80" else c for c in s)
    at = []
    for w in _HINT_WORDS:
        i = low.find(w)
        while i >= 0:
            at.append(i)
            i = low.find("\n", i)
            if i >= 0:
                i = low.find(w, i)
    at += [m.start() for m in _LONG_RUN.finditer(s)]
    if "://" in s:
        at += [m.start() for m in _URL_HINT.finditer(s)]
    if "%" in s or "\\" in s:
        at += [m.start() for m in _ENC_HINT.finditer(s)]
    return at


def words_of(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def secret_name(name: str) -> int:
    """2: the name says credential; 1: it says some key; 0: neither.  Only its last words count."""
    w = words_of(name)
    if not w:
        return 0
    while len(w) > 1 and w[-1].isdigit():
        w.pop()
    if w[-1] in _LAST_WORD:
        return 2
    if w[-1] == "key":
        return 2 if len(w) > 1 and w[-2] in _KEY_LEAD else 1
    if len(w) > 1 and w[-1] == "id" and w[-2] == "key" and "access" in w:
        return 2
    return 0


def _counts(v: str) -> tuple[int, int, int, int]:
    up = sum(c.isupper() for c in v)
    low = sum(c.islower() for c in v)
    dig = sum(c.isdigit() for c in v)
    return up, low, dig, len(v) - up - low - dig


def random_looking(v: str) -> bool:
    """A string of the form of a random key: base64, letters and digits, or hex of a usual length."""
    if re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{64}", v):
        return True
    up, low, dig, _ = _counts(v)
    return 28 <= len(v) <= 100 and bool(re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", v)) and up >= 3 and low >= 3 and dig >= 2 and "//" not in v


def credible(v: str, strength: int) -> bool:
    """Whether a value in a place meant for a credential is one that could be used."""
    if len(v) < 8 or _PLACEHOLDER.search(v) or any(c.isspace() for c in v):
        return False
    if _NOT_SECRET.search(v) and not (v[0] in "/@" and random_looking(v)):
        return False
    if _PREFIX_RE.match(v):
        return True
    if re.fullmatch(r"[0-9a-f]{40}", v):
        return strength >= 3
    if re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{48}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}", v):
        return strength >= 1
    up, low, dig, other = _counts(v)
    if re.fullmatch(r"[A-Z0-9]{4,8}(?:-[A-Z0-9]{4,8}){2,}", v):
        return dig >= 1
    if len(v) >= 20 and up >= 3 and low >= 3 and dig >= 2 and re.fullmatch(r"[A-Za-z0-9+/=_.-]+", v):
        return not re.fullmatch(r"(?:[A-Z]?[a-z]+|\d+)(?:[-_./][A-Za-z]?[a-z]+|\d+)*", v)
    if strength < 2:
        return False
    if re.fullmatch(r"(?:[a-z]+[:._/-])*v?\d{0,2}(?:\.\d+)*", v) or re.fullmatch(r"[a-z]+(?:[:._/-][a-z]+)*(?:[:._/-]?v?\d{1,2})?", v):
        return False
    if re.search(r"[(){}\[\];,]", v) and not re.search(r"\d", v):
        return False
    if len(v) >= 10 and dig >= 1 and up >= 1 and low >= 4 and not re.fullmatch(r"[A-Za-z]+\d{1,2}", v):
        return True
    return (dig >= 3 and up + low >= 3) or (up >= 2 and low >= 2 and dig >= 1) or (dig >= 1 and other >= 1 and up >= 1 and low >= 4)


# ---- containers
def _der(b: bytes, pos: int):
    """Tag, value start and end of one DER element, or None."""
    if pos + 2 > len(b):
        return None
    tag, n, pos = b[pos], b[pos + 1], pos + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or pos + k > len(b):
            return None
        n = int.from_bytes(b[pos : pos + k], "big")
        pos += k
    return (tag, pos, pos + n) if pos + n <= len(b) else None


def is_private_key(b: bytes) -> bool:
    """PKCS#1, PKCS#8, encrypted PKCS#8 and SEC1 keys in DER, OpenSSH keys, and JWK with a private member."""
    if b.startswith(b"openssh-key-v1\0") or b.startswith(b"PuTTY-User-Key-File"):
        return True
    if b[:1] == b"{":
        try:
            d = json.loads(b)
        except ValueError:
            return False
        return isinstance(d, dict) and "kty" in d and ("d" in d or d.get("kty") == "oct" and "k" in d)
    top = _der(b, 0)
    if not top or top[0] != 0x30:
        return False
    parts, pos = [], top[1]
    while pos < top[2] and len(parts) < 12:
        e = _der(b, pos)
        if not e or e[2] > top[2]:
            return False
        parts.append((e[0], e[1], e[2]))
        pos = e[2]
    tags = [t for t, _, _ in parts]
    if len(tags) >= 9 and tags[:9] == [2] * 9:
        return True  # PKCS#1
    if len(tags) >= 3 and tags[:3] == [2, 0x30, 4]:
        return True  # PKCS#8
    if len(tags) >= 2 and tags[:2] == [2, 4] and b[parts[0][1] : parts[0][2]] == b"\1":
        return True  # SEC1
    if tags == [0x30, 4]:  # encrypted PKCS#8: algorithm 1.2.840.113549.1.5.x or 1.12
        inner = b[parts[0][1] : parts[0][2]]
        return b"\x2a\x86\x48\x86\xf7\x0d\x01" in inner
    return False


def _b64(v: str) -> bytes | None:
    v = v.replace("-", "+").replace("_", "/").rstrip("=")
    if len(v) % 4 == 1:
        return None
    try:
        return base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _texty(b: bytes) -> str | None:
    """The text of decoded bytes if they look like text."""
    if len(b) < 6:
        return None
    try:
        t = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    bad = sum(1 for c in t if not (c.isprintable() or c in "\r\n\t"))
    return t if not bad else None


def _unescape(v: str) -> str:
    return _ESC1.sub(lambda m: chr(min(int(m[1] or m[2] or m[3] or "0", 16) if not m[4] else int(m[4], 8), 0x10FFFF)), v)


# ---- scan
def _value_at(s: str, pos: int, quote: str) -> tuple[int, int]:
    """Span of the value that begins at pos; the quote is already passed."""
    if quote:
        m = re.compile(r"(?:[^\\%s\n]|\\.)*" % quote).match(s, pos)
        return pos, m.end()
    m = re.compile(r"[^\s\"'`,;)}\]#]+(?:#[^\s\"'`,;)}\]]+)*").match(s, pos)
    return (pos, m.end()) if m else (pos, pos)


def _joined(s: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Strings that stand in pieces ("a" + "b", or an array joined with nothing), with the pieces' spans."""
    out = []
    if "+" in s or "\\\n" in s:
        run: list[tuple[int, int]] = []
        end = None
        for m in _LITERAL.finditer(s):
            k = m.lastindex
            if end is not None and re.fullmatch(r"\s*\+\s*", s[end : m.start()]):
                run.append(m.span(k))
            else:
                if len(run) > 1:
                    out.append(("".join(s[a:b] for a, b in run), run))
                run = [m.span(k)]
            end = m.end()
        if len(run) > 1:
            out.append(("".join(s[a:b] for a, b in run), run))
    if ".join" in s:
        for m in _ARRAY_JOIN.finditer(s):
            run = [x.span(x.lastindex) for x in _LITERAL.finditer(s, m.start(1), m.end(1))]
            if len(run) > 1:
                out.append(("".join(s[a:b] for a, b in run), run))
    return out


_GIVEN = re.compile(r"([\w$.\-]+)[\"'`\])]*[ \t]*(?::[ \t]*\w+[ \t]*)?(?:=|:|\|\||\?\?)\Z")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")


def _names_before(s: str, pos: int) -> int:
    """Strength of the name that is given the value whose literal begins before pos."""
    e = pos - (pos > 0 and s[pos - 1] in "\"'`")
    for opened in (True, False):
        while e and s[e - 1].isspace():
            e -= 1
        if opened and e and s[e - 1] == "[":
            e -= 1
    a = e
    for stop in (e - 60, 0):  # the assignment with a type, then what is left of the name
        while a > max(stop, 0) and (s[a - 1] in _NAME_CHARS or stop and s[a - 1] not in "\n;{},("):
            a -= 1
    m = _GIVEN.search(s[a:e])
    return secret_name(m[1]) if m else 0


def scan_layer(s: str, depth: int) -> list[tuple[int, int, str, int]]:
    """Findings (start, end, kind, layers) of one layer, possibly overlapping."""
    found: list[tuple[int, int, str, int]] = []
    add = found.append
    for m in _PREFIX_RE.finditer(s):
        if not re.search(r"(?i)example|xxxx|0{8}|\.{3}", m[0]):
            add((m.start(), m.end(), "token", depth))
    if "://" in s:
        for m in _URL.finditer(s):
            v = m[2]
            if not _PLACEHOLDER.search(v) and not re.fullmatch(r"(?i)pass(?:word)?|pwd|secret|token|\d{1,5}", v) and (credible(v, 2) or len(v) >= 6 and _counts(v)[2] and _counts(v)[3]):
                add((m.start(2), m.end(2), "url_password", depth))
    if "=" in s and ("?" in s or "&" in s):
        for m in _QUERY.finditer(s):
            if (k := secret_name(m[1])) or m[1].lower() in ("sig", "signature", "code"):
                if credible(unq(m[2]), max(1, k) if k else 1):
                    add((m.start(2), m.end(2), "query_token", depth))
    for m in _HEADER.finditer(s):
        v = m[2]
        if m[1].lower() == "basic":
            b = _b64(v)
            t = _texty(b) if b else None
            if t and ":" in t and len(t.split(":", 1)[1]) >= 4 and not _PLACEHOLDER.search(t.split(":", 1)[1]):
                add((m.start(2), m.end(2), "basic_auth", depth + 1))
        elif credible(v, 3 if m[1].lower() == "bearer" else 1) and (m[1].lower() == "bearer" or _counts(v)[2] >= 2):
            add((m.start(2), m.end(2), "bearer", depth))
    if re.search(r"(?i)x-|authorization|api-key|cookie", s):
        for m in _HEADER_NAME.finditer(s):
            if m[2].lower() not in ("bearer", "basic", "token") and (secret_name(m[1]) or m[1].lower().startswith("x-auth")):
                if credible(m[2], 2):
                    add((m.start(2), m.end(2), "header", depth))
    for m in _ENV_DEFAULT.finditer(s):
        k = secret_name(m[1])
        if k:
            a, b = _value_at(s, m.end(), m[2])
            if credible(s[a:b], k):
                add((a, b, "default_value", depth))
    if re.search(r"(?i)pass|secret|token|key|auth|cred|pwd|\bpat\b", s):
        for m in _ASSIGN.finditer(s):
            k = secret_name(m[1].rsplit(".", 1)[-1])
            if not k:
                continue
            a, b = _value_at(s, m.end(), m[2])
            v = s[a:b]
            if not m[2] and not re.match(r"[A-Za-z0-9+/=_.!@#$%^&*~?|:-]+\Z", v):
                continue
            if not m[2] and re.match(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+\Z", v) and not _PREFIX_RE.match(v):
                continue
            line_end = s.find("\n", b)
            tail = s[b : line_end if line_end >= 0 else len(s)]
            strength = k + (1 if k == 2 and not re.search(r"(?i)commit|revision|checksum|digest|sha|hash", tail) else 0)
            if not m[2] and s[b : b + 1] == "(":
                continue
            if credible(v, strength):
                add((a, b, "assignment", depth))
    if "-" in s:
        for m in _ARGV.finditer(s):
            k = secret_name(m[1])
            if k == 2 and credible(m[2], 2):
                add((m.start(2), m.end(2), "argument", depth))
        for m in _USERPASS.finditer(s):
            if credible(m[2], 2) or (len(m[2]) >= 6 and _counts(m[2])[2] >= 1 and not _PLACEHOLDER.search(m[2])):
                add((m.start(2), m.end(2), "argument", depth))
    if re.search(r"(?i)log.?in|sign.?in|pass|pwd|cred|account|token|secret|key|\bpw\b", s):
        for m in _PROSE.finditer(s):
            if credible(m[1], 2) and not re.search(r"[(){}<>=]", m[1]) and "." not in m[1].rstrip(".")[:-3]:
                add((m.start(1), m.end(1), "prose", depth))
    for m in _RANDOM_ARG.finditer(s):
        up, lo, dig, _ = _counts(m[1])
        if up >= 4 and lo >= 4 and dig >= 2:
            add((m.start(1), m.end(1), "random_argument", depth))
    return found


def unq(v: str) -> str:
    return unquote_to_bytes(v).decode("utf-8", "replace") if "%" in v else v


def _decoded(s: str):
    """(start, end, text or bytes) of every literal of a layer that decodes."""
    for m in _B64.finditer(s):
        v = m[0]
        if (len(v) >= 16 and v.isalpha() and (v.islower() or v.isupper())):
            continue
        if len(v) < 200 and re.fullmatch(r"[a-z]+|[A-Z_]+|(?:[A-Za-z][a-z]+)+\d{0,3}|[0-9a-f]+|\d+", v):
            continue
        b = _b64(v)
        if not b:
            continue
        if (t := _texty(b)) is not None:
            yield m.start(), m.end(), t
        elif is_private_key(b):
            yield m.start(), m.end(), b
    for m in _HEX.finditer(s):
        b = bytes.fromhex(m[1])
        if (t := _texty(b)) is not None:
            yield m.start(), m.end(), t
        elif is_private_key(b):
            yield m.start(), m.end(), b
    if "%" in s:
        for m in _PCT.finditer(s):
            t = _texty(unquote_to_bytes(m[0]))
            if t is not None and t != m[0]:
                yield m.start(), m.end(), t
    if "\\x" in s or "\\u" in s or re.search(r"\\[0-7]{3}", s):
        for m in _LITERAL.finditer(s):
            k = m.lastindex
            v = m[k]
            if v.count("\\") >= 4 and _ESC1.search(v):
                yield m.start(k), m.end(k), _unescape(v)


def scan(s: str) -> list[tuple[int, int, str, int]]:
    """All credentials of a text: (start, end, kind, layers of encoding), sorted, not overlapping."""
    return _merge(s, _scan(s, 0)) if s else []


_BROKEN_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+[^\n]{0,9}\n")
_FIRST_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{24,})(?:\\[nr])*[ \t\"'`+,\\]*\r?\n")
_NEXT_RUN = re.compile(r"[ \t#*/>|\"'`+]*(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]+={0,2})(?:\\[nr])*[ \t\"'`+,;)\\\]]*\r?(?:\n|\Z)")
_PIECES = re.compile(r"[\"'`]\s*\+\s*[\"'`]|\]\s*\.join\(")


def _scan(s: str, depth: int) -> list[tuple[int, int, str, int]]:
    """Findings of a text and of all that decodes in it.  Keys over several lines and joined pieces are
    looked for in the whole text, everything else in the lines that hold a hint."""
    found = []
    if "PRIVATE KEY" in s:
        for m in _PEM.finditer(s):
            if _B64RUN.search(m[1]) or len(re.sub(r"[^A-Za-z0-9+/]", "", m[1])) >= 40:
                found.append((m.start(), m.end(), "private_key", depth))
    if _PIECES.search(s):
        found += _scan_joined(s, depth)
    if depth < MAX_DEPTH and _BROKEN_RUN.search(s):
        found += _scan_wrapped(s, depth)
    done = -1
    for at in sorted(hints(s)):
        if at < done:
            continue
        a = s.rfind("\n", 0, at) + 1
        b = s.find("\n", at)
        done = b if b >= 0 else len(s)
        line = s[a:done]
        for x, y, kind, layer in scan_layer(line, depth):
            found.append((a + x, a + y, kind, layer))
        if depth < MAX_DEPTH:
            for x, y, t in _decoded(line):
                found += [(a + x, a + y, kind, layer) for kind, layer in _decoded_kind(line, x, t, depth)]
    if depth < MAX_DEPTH and "`" in s and "\\" in s:
        for m in re.finditer(r"`((?:[^`\\]|\\.)*)`", s, re.S):
            if "\n" in m[1] and m[1].count("\\") >= 4 and _ESC1.search(m[1]):
                found += [(m.start(1), m.end(1), kind, layer) for kind, layer in _decoded_kind(s, m.start(1), _unescape(m[1]), depth)]
    return found


def _decoded_kind(s: str, a: int, t, depth: int):
    """Kind and layer of a literal at a that decodes to t; empty if nothing usable is in it."""
    if isinstance(t, bytes):
        return [("key_container", depth + 1)]
    inner = [f for f in _scan(t, depth + 1) if f[2] != "random_argument"]
    if inner:
        return [("encoded_" + inner[0][2].removeprefix("encoded_"), max(inner[0][3], depth + 1))]
    if (k := _names_before(s, a)) and credible(t, k + 1):
        return [("encoded_value", depth + 1)]
    if t[:1] == "{" and is_private_key(t.encode()):
        return [("key_container", depth + 1)]
    return []


def _scan_joined(s: str, depth: int):
    found = []
    for text, spans in _joined(s):
        a, b = spans[0][0], spans[-1][1]
        strength = _names_before(s, a)
        if "PRIVATE KEY" in text and _PEM.search(text) or strength and credible(text, strength + 1):
            found.append((a, b, "joined", depth))
            continue
        values = [(x, y) for x, y, *_ in scan_layer(text, depth)]
        if depth < MAX_DEPTH:
            values += [(x, y) for x, y, t in _decoded(text) if _decoded_kind(text, x, t, depth)]
        if values:
            found += [(*_in_pieces(spans, x, y), "joined", depth) for x, y in values]
        elif len(spans) >= 2 and random_looking(text) and _NOT_SECRET.search(text[:8]) is None:
            found.append((a, b, "joined", depth))
    return found


def _scan_wrapped(s: str, depth: int):
    """Base64 broken over lines, as in a template, a comment or a here-document, read as one literal.
    All its lines but the first and the last are equally long."""
    found, done = [], 0
    for broken in _BROKEN_RUN.finditer(s):
        line = s.rfind("\n", 0, broken.start()) + 1
        if line < done or not (m := _FIRST_RUN.search(s, line, broken.end())):
            continue
        runs, width = [m.span(1)], None
        while m := _NEXT_RUN.match(s, m.end()):
            runs.append(m.span(1))
            n = len(m[1])
            if width is not None and n != width or m[1].endswith("="):
                break
            width = n
        done = runs[-1][1]
        # the run may end on a line that is no base64 any more
        while len(runs) > 1:
            b = _b64("".join(s[x:y] for x, y in runs))
            t = b if b and is_private_key(b) else _texty(b) if b else None
            if t is not None:
                found += [(runs[0][0], runs[-1][1], "wrapped", layer) for _, layer in _decoded_kind(s, runs[0][0], t, depth)]
                break
            if runs[-1][1] - runs[-1][0] == width:
                break
            runs.pop()
    return found


def _in_pieces(spans: list[tuple[int, int]], x: int, y: int) -> tuple[int, int]:
    """Place in the source of the characters x to y of a joined text, whatever stands between its pieces."""
    start = end = None
    at = 0
    for a, b in spans:
        n = b - a
        if start is None and x < at + n:
            start = a + x - at
        if y <= at + n:
            end = a + y - at
            break
        at += n
    return spans[0][0] if start is None else start, spans[-1][1] if end is None else end


def _merge(s: str, found):
    """Overlapping findings become one; it keeps the earliest start, the kind of the widest part."""
    out: list[list] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if out and f[0] < out[-1][1]:
            if f[1] > out[-1][1]:
                out[-1][1] = f[1]
        else:
            out.append(list(f))
    return [tuple(f) for f in out]


_KEEP = re.compile(r"-----(?:BEGIN|END)[^-]*-----|\\[rn]|[^A-Za-z0-9]")


def _masked_key(v: str) -> str:
    """Letters and digits masked; markers, line ends and what stands between joined lines stay."""
    out, p = [], 0
    for m in _KEEP.finditer(v):
        out.append("X" * (m.start() - p) + m[0])
        p = m.end()
    return "".join(out) + "X" * (len(v) - p)


def redact(s: str, found) -> str:
    """The text with every finding masked; its length, lines, quotes and joins stay as they were."""
    if not found:
        return s
    pieces = sorted({p for _, spans in _joined(s) for p in spans}) if any(f[2] == "joined" for f in found) else []
    parts, pos = [], 0
    for a, b, kind, _ in found:
        parts.append(s[pos:a])
        v = s[a:b]
        if kind == "joined" and "PRIVATE KEY" not in v:
            # all of the pieces is the secret, all between them is code
            at = a
            for x, y in pieces[max(0, bisect_right(pieces, (a, len(s))) - 1) :]:
                x, y = max(x, at), min(y, b)
                if x >= b:
                    break
                if x < y:
                    parts.append(s[at:x] + "".join(c if c in "\r\n" else "X" for c in s[x:y]))
                    at = y
            parts.append(s[at:b])
        elif kind in ("private_key", "joined", "wrapped"):
            parts.append(_masked_key(v))
        else:
            parts.append("".join(c if c in "\r\n" else "X" for c in v))
        pos = b
    parts.append(s[pos:])
    return "".join(parts)
