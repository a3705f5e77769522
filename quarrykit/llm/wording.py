"""Canonical form of a short statement or question, and whether two of them say the same.

A text is brought to one spelling, remarks to the reader go, repository names become one
token, fixed turns of phrase become one form, function words go.  What is left is compared
token by token: tokens must be equal or differ by a slip of the key.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words that carry no name.
FUNCTION_WORDS = frozenset(
    "a an the of to in on at by for from with and or but so then than that this these those it its is are was were be been does do did has have had"
    " there here also just only please exactly currently actually now within into per each".split()
)
# Turns of phrase that mean the same; the left side is put as the right.
PHRASES = [
    (r"\b(?:what is the reason|for what reason|what s the reason)(?: that| why)?(?: the code has| the code)?\b", "why"),
    (r"\bwho calls\b", "what calls"),
    (r"\btouches\b", "touch"),
    (r"\b(?:through|by|via|out of) (?:what|which)\b", "from which"),
    (r"\b(?:jointly|in combination)\b", "work together"),
    (r"^(?:tell me|explain|please tell me|can you tell me|do you know|i wonder)\b", ""),
    (r"\b(?:in what way|by what means|what way)\b", "how"),
    (r"\b(?:even )?(?:in case|in the case that|in the event that|whenever|every time|each time|as soon as|if|when)\b(?: that)?(?= |$)", "when"),
    (r"\beven when\b", "when"),
    (r"\b(?:does not|doesn t|doesnt|do not|don t|dont|will not|won t|never)\b", "not"),
    (r"\bbefore returning\b", "before it returns"),
    (r"\b(?:on demand|only when needed)\b", "lazily"),
    (r"\b(?:what|which) (?:endpoint|http route|api route|route)\b", "which route"),
    (r"\b(?:what|which) (?:setting|flag|switch|config option|configuration option|option)\b", "which option"),
    (r"\b(?:what|which) (?:source files|files)\b", "which files"),
    (r"\b(?:what|which) (?:source modules|modules)\b", "which modules"),
    (r"\b(?:no more than|a maximum of|up to|at most)\b", "at most"),
    (r"\b(?:greater than|over|above|more than)\b", "more than"),
    (r"\b(?:for what reason|what is the reason)\b", "why"),
    (r"\b(?:in what place|in which file|in what file|(?:in |at )?(?:what|which) (?:location|place|spot))\b", "where"),
    (r"^(?:can|could|would) you (?:please )?(?:point me to|show me|tell me) (?:the (?:location|place|spot)(?: where)?|where)\b", "where"),
    (r"\bdeclared\b", "defined"),
]
_PHRASES = [(re.compile(a), b) for a, b in PHRASES]
_SENTENCE = re.compile(r"(?<=[.!?])[\s\"')\]]+(?=\S)|\n+|(?<=[?!])(?=\s*\()")
_LEAD = re.compile(r"^(?:[-*•>#]+\s*|\d+[.)]\s+|[\[(][^\])]{1,20}[\])]\s+)+")
_COLON = re.compile(r"^([^:]{1,30}):\s+(?=\S)")
_COMMA = re.compile(
    r"^(?:as of (?:today|now)|in this (?:repository|repo|project|codebase)|for the record|to be clear|note that|currently|just curious|hi|hello|hey|please|so|ok|okay|well|quick question|question|by the way|btw|fyi|at present|today)\b[ ,:]+",
    re.I,
)
# Two-letter function words with their letters swapped.
_SWAPPED = {w[::-1]: w for w in "if is it of to in at be on an by".split() if w[::-1] not in ("no",)}
_WORD = re.compile(r"[\w$]+(?:['’][a-z]+)?(?:-[\w$]+)*")
_ZERO = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD], None)


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, in a band; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    prev2, prev = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        cur = [most + 1] * (len(b) + 1)
        cur[0] = i
        for j in range(lo, hi + 1):
            c = prev[j - 1] + (a[i - 1] != b[j - 1])
            if prev[j] + 1 < c:
                c = prev[j] + 1
            if cur[j - 1] + 1 < c:
                c = cur[j - 1] + 1
            if prev2 is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and prev2[j - 2] + 1 < c:
                c = prev2[j - 2] + 1
            cur[j] = c
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[len(b)], most + 1)


# Words by which a sentence speaks to the reader, the verbs a request begins with, and words of remarks.
_ADDRESS = frozenset("i i'm i'd i've im me my we us our you your please pls thanks thank thx sorry hi hello hey cheers".split())
_REQUEST = frozenset("cite name see give show quote answer reply respond keep list note explain describe mention point check be".split())
_REMARK = _ADDRESS | _REQUEST | frozenset("short brief briefly line lines code file files source sources path answer answers question quick urgent reference references".split())
_IDENTIFIER = re.compile(r"`|[a-z][A-Z]|\w_\w|\d|[A-Za-z]\.[A-Za-z]|\w\(\)")
_ASKING = re.compile(r"(?i)\b(?:what|which|where|why|how|who|when|whose)\b")


def _is_remark(sentence: str) -> bool:
    """Whether a sentence only speaks to the reader: it names no code and asks nothing about it."""
    if _IDENTIFIER.search(sentence) or (sentence.rstrip(" \"')]").endswith("?") and _ASKING.search(sentence)):
        return False
    w = [x.lower().replace("’", "'") for x in _WORD.findall(sentence)]
    if not w or _ADDRESS & set(w) or w[0] in _REQUEST:
        return True
    if len(w) <= 4 and any(osa(w[0], x, 1) <= 1 for x in _REQUEST if len(x) > 2):
        return True
    return all(x in FUNCTION_WORDS or any(osa(x, y, 1) <= (len(y) > 3) for y in _REMARK) for x in w)


def statements(text: str) -> list[str]:
    """All sentences but remarks to the reader, without list marks and lead-in; the longest if all are remarks."""
    t = unicodedata.normalize("NFKC", text).translate(_ZERO).strip()
    t = re.sub(r"\s*\([^()]{0,40}\)\s*$", "", t)
    parts = [p for p in _SENTENCE.split(t) if p and p.strip()]
    if len(parts) > 1:
        parts = [p for p in parts if not _is_remark(p)] or [max(parts, key=lambda p: (len(_WORD.findall(p)), len(p)))]
    return [_without_lead(p) for p in parts]


def _without_lead(t: str) -> str:
    for _ in range(3):
        before = t
        t = _LEAD.sub("", t.strip())
        m = _COLON.match(t)
        if m and len(_WORD.findall(m[1])) <= 4 and len(_WORD.findall(t[m.end() :])) >= 3:
            t = t[m.end() :]
        m = _COMMA.match(t)
        if m and len(_WORD.findall(t[m.end() :])) >= 3:
            t = t[m.end() :]
        if t == before:
            break
    return t


@lru_cache(maxsize=4)
def _repo_parts(repos: frozenset[str]) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Names that stand alone, first parts and last parts of repository names.

    A first part stands alone if it is a name itself or goes with several last parts.
    """
    with_parts: dict[str, set[str]] = {}
    for r in repos:
        if "-" in r:
            a, b = r.rsplit("-", 1)
            with_parts.setdefault(a, set()).add(b)
    alone = {r for r in repos if "-" not in r} | {a for a, b in with_parts.items() if len(b) > 1}
    return frozenset(alone | repos), frozenset(with_parts.keys() | {r for r in repos if "-" not in r}), frozenset(b for x in with_parts.values() for b in x)


def _slips(w: str, among: frozenset[str], most: int) -> int:
    if w in among:
        return 0
    return min((osa(w, r, most) for r in among if abs(len(r) - len(w)) <= most), default=most + 1)


@lru_cache(maxsize=100_000)
def is_repo(word: str, repos: frozenset[str]) -> bool:
    """A repository's short name, known or put together of known parts, with up to two slips in a name of two parts."""
    alone, first, last = _repo_parts(repos)
    if word in alone:
        return True
    if "-" in word:
        a, b = word.rsplit("-", 1)
        d = _slips(a, first, 2)
        return d <= 2 and d + _slips(b, last, 2) <= 2
    return False


def canonical(text: str | None, repos: frozenset[str]) -> list[str]:
    """Tokens of a text in canonical form; none for an empty text.

    Identifiers lose their case and underscores; a repository's short name becomes "§".
    """
    return [w for t in statements(text) for w in _canonical_sentence(t, repos)] if text else []


def _canonical_sentence(t: str, repos: frozenset[str]) -> list[str]:
    words = []
    for w in _WORD.findall(t):
        low = w.lower().replace("’", "'")
        if is_repo(low, repos):
            words.append("§")
            continue
        if "-" in low:
            words += [x for x in low.split("-") if x]
            continue
        low = _SWAPPED.get(low, low)
        words.append(low.replace("_", "").replace("'", ""))
    s = " ".join(words)
    for rx, to in _PHRASES:
        s = rx.sub(to, s)
    return [w for w in s.split() if w not in FUNCTION_WORDS]


# Words of sentence frames; they are compared but are no names.
FRAME_WORDS = frozenset(
    "what which where why how who when not no two more most than holds rows arrive once comes back sent gone disagree entries files work together option"
    " default answer route return returns throws logs warning accepts touches touch falls again caller calls modules import imports defined exported entry"
    " point data over until nothing happens lazily kept request through every even before".split()
)


@lru_cache(maxsize=100_000)
def frame_like(token: str) -> bool:
    """A frame or function word, or one slip away from one."""
    return token in FRAME_WORDS or any(osa(token, w, 1) <= 1 for w in _FRAMES if abs(len(w) - len(token)) <= 1)


def name_string(tokens: list[str]) -> str:
    """The tokens without frame words and their slips, as one string: what the segment join compares."""
    names = [t for t in tokens if t != "§" and not frame_like(t)]
    return " ".join(names if names else tokens)


_FRAMES = FRAME_WORDS | {w for w in FUNCTION_WORDS if len(w) > 1}


def _may_skip(t: str, real: frozenset[str]) -> bool:
    return t in FRAME_WORDS or t == "§" or (t not in real and frame_like(t))


def without_slips(a: list[str], b: list[str], seen: dict[str, int], least: int, ratio: int) -> frozenset[str]:
    """The words of two texts that are spelt right: seen in `least` contexts, and not `ratio` times rarer than
    the word one slip away that stands in the other text."""
    out = {t for t in {*a, *b} if seen.get(t, 0) >= least}
    for mine, others in ((set(a) - set(b), set(b) - set(a)), (set(b) - set(a), set(a) - set(b))):
        for x in mine & out:
            if any(seen.get(y, 0) >= ratio * seen[x] and osa(x, y, _most_slips(x, y)) <= _most_slips(x, y) for y in others):
                out.discard(x)
    return frozenset(out)


def same(a: list[str], b: list[str], common: frozenset[str], slips: float = 3, real: frozenset[str] | None = None) -> bool:
    """Whether two canonical texts say the same.

    common: the words that are spelt right because many texts have them.  Two different
    common words are different names, never a slip.  real: the words that are no slip of a function
    word, which stands in nearly every text; if not given, the common ones.
    """
    real = common if real is None else real
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 3:
        return False
    n, m = len(a), len(b)
    big = 99
    skip = [_may_skip(t, real) for t in b]
    prev = [j if all(skip[:j]) else big for j in range(m + 1)]
    prev2 = None
    for i in range(1, n + 1):
        skip_a = _may_skip(a[i - 1], real)
        cost_a = 1 if a[i - 1] in FRAME_WORDS or a[i - 1] == "§" else 0.5
        cur = [prev[0] + cost_a if skip_a else big]
        for j in range(1, m + 1):
            c = prev[j - 1] + _token_cost(a[i - 1], b[j - 1], common)
            if skip_a:
                c = min(c, prev[j] + cost_a)
            if skip[j - 1]:
                c = min(c, cur[j - 1] + (1 if b[j - 1] in FRAME_WORDS or b[j - 1] == "§" else 0.5))
            # a blank lost or put in: two tokens against one
            if i > 1 and prev2 is not None and a[i - 2] + a[i - 1] == b[j - 1]:
                c = min(c, prev2[j - 1] + 1)
            if j > 1 and b[j - 2] + b[j - 1] == a[i - 1]:
                c = min(c, prev[j - 2] + 1)
            cur.append(c)
        prev2, prev = prev, cur
    return prev[m] <= slips


def _most_slips(x: str, y: str) -> int:
    shortest = min(len(x), len(y))
    return 1 if shortest <= 4 else 2 if shortest <= 9 else 3


def _token_cost(x: str, y: str, common: frozenset[str]) -> int:
    if x == y:
        return 0
    if x.isdigit() or y.isdigit() or "§" in (x, y):
        return 99
    if x in common and y in common:
        return 99
    most = _most_slips(x, y)
    d = osa(x, y, most)
    return d if d <= most else 99
