"""Words of a text whatever its dress, and Smith-Waterman alignment of two word lists."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import xxhash

# Characters that look like Latin letters or digits, and the letters they stand for.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "ԁ": "d", "ɡ": "g", "һ": "h", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ϲ": "c", "ϳ": "j", "ı": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "һ": "h", "ӏ": "l", "ԍ": "g", "ѵ": "v",
}
_LOOK = str.maketrans(_LOOKALIKES)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]{0,300}>", re.S)
_BLOCK = re.compile(r"(?i)</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|hr|section|article|pre|blockquote)\b")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_WRAP = re.compile(r"([^\W\d_])[-‐‑]\r?\n[ \t>*|#]*([^\W\d_])")
_EMPH = re.compile(r"[*_~`\\]+")
_WORD = re.compile(r"[^\W_]+")


def normal_text(text: str) -> str:
    """Lower case in one script, without markup, invisible characters and line layout."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        t = "".join(c for c in t if unicodedata.category(c) != "Cf")
        t = unicodedata.normalize("NFKD", t.lower())
        t = "".join(c for c in t if not unicodedata.combining(c)).translate(_LOOK)
    else:
        t = t.lower()
    if "<" in t:
        t = _TAG.sub(lambda m: " " if _BLOCK.match(m[0]) or m[0].startswith("<!--") else "", t)
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    t = _WRAP.sub(r"\1\2", t)
    return _EMPH.sub("", t)


def words(text: str | None) -> list[str]:
    return _WORD.findall(normal_text(text)) if text else []


_hash: dict[str, int] = {}
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hashed(w: str) -> int:
    h = _hash.get(w)
    if h is None:
        h = xxhash.xxh64_intdigest(w)
        if len(w) <= 40:
            if len(_hash) >= 200_000:
                _hash.clear()
            _hash[w] = h
    return h


def gram_hashes(ws: list[str], n: int) -> list[int]:
    """A 64-bit hash of every run of n words, by position."""
    return gram_array(ws, n).tolist()


def gram_array(ws: list[str], n: int) -> np.ndarray:
    if n < 1 or len(ws) < n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hashed, ws), np.uint64, len(ws))
    roll = np.zeros(len(ws) - n + 1, np.uint64)
    for j in range(n):
        roll = roll * _BASE + h[j : j + len(roll)]
        roll ^= roll >> np.uint64(31)
    roll *= _MIX
    return (roll ^ (roll >> np.uint64(29))).view(np.int64)


def local_alignments(a: list[str], b: list[str], least: int = 1, enough: int | None = None) -> Iterator[list[tuple[int, int]]]:
    """Local alignments as lists of matching places (in a, in b), best score first, no match in two of them.

    Match 2, mismatch and gap -1 (Waterman and Eggert: the matches of one alignment are no matches
    in the next).  Ends below the score `least`, or after an alignment of `enough` matches.
    A word of b that two words of a make up, or the reverse, is matched by the caller's normal form, not here.
    """
    m = len(b)
    places: dict[str, set[int]] = {}
    for j, y in enumerate(b, 1):
        places.setdefault(y, set()).add(j)
    equal = [set(places.get(x, ())) for x in a]
    while True:
        best, end, ways, prev = 0, (0, 0), [bytearray(m + 1)], [0] * (m + 1)
        for i, row in enumerate(equal, 1):
            cur, way, left = [0] * (m + 1), bytearray(m + 1), 0
            if row or any(prev):
                for j in range(1, m + 1):
                    s = prev[j - 1]
                    if j in row:
                        s += 2
                        way[j] = 1
                        if s > best:
                            best, end = s, (i, j)
                    else:
                        w = 1
                        if prev[j] > s:
                            s, w = prev[j], 2
                        if left > s:
                            s, w = left, 3
                        s -= 1
                        if s > 0:
                            way[j] = w
                        else:
                            s = 0
                    cur[j] = left = s
            ways.append(way)
            prev = cur
        if best < max(1, least):
            return
        i, j = end
        pairs = []
        while w := ways[i][j]:
            if w == 1:
                i, j = i - 1, j - 1
                if j + 1 in equal[i]:
                    pairs.append((i, j))
            elif w == 2:
                i -= 1
            else:
                j -= 1
        pairs.reverse()
        yield pairs
        if enough is not None and len(pairs) >= enough:
            return
        for i, j in pairs:
            equal[i].discard(j + 1)


def smith_waterman(a: list[str], b: list[str]) -> tuple[int, int, int, int, int]:
    """Best local alignment: (matches, first and last place + 1 in a, the same in b)."""
    p = next(local_alignments(a, b), None)
    return (len(p), p[0][0], p[-1][0] + 1, p[0][1], p[-1][1] + 1) if p else (0, 0, 0, 0, 0)


LEAST_SCORE = 6  # of a stretch: three words in a row


def stretches(item: list[str], doc: list[str], hits: list[tuple[int, int]], slack: int = 10) -> list[list[tuple[int, int]]]:
    """Local alignments of an item with the places of a document at which seeds hit, as matching places.

    hits: (place in the document, place in the item).  Hits on near diagonals share a window; every
    stretch of a window is given, not the best alone, for a window may hold several.
    """
    windows: list[list[int]] = []
    for d, i in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        lo, hi = d - i - slack, d - i + len(item) + slack
        for w in windows:
            if abs(w[0] - lo) <= 2 * slack:
                w[0], w[1] = min(w[0], lo), max(w[1], hi)
                break
        else:
            windows.append([lo, hi])
    out = set()
    for lo, hi in windows:
        lo, hi = max(0, lo), min(len(doc), hi)
        for pairs in local_alignments(item, doc[lo:hi], min(LEAST_SCORE, 2 * len(item)), len(item) - 2):
            out.add(tuple((i, lo + j) for i, j in pairs))
    return [list(p) for p in sorted(out)]


def _spanned(pairs: list[tuple[int, int]]) -> int:
    return pairs[-1][0] - pairs[0][0] + 1 if pairs else 0


def coverage(item: list[str], doc: list[str], hits: list[tuple[int, int]], pure: float = 0.75) -> tuple[int, int]:
    """Matched words and spanned words of an item in a document: one stretch, or two in order with other text between.

    The most words of which the share `pure` of the spanned ones match; if none is so pure, the most.
    """
    st = stretches(item, doc, hits)
    best = (False, 0, 0)

    def offer(matched: int, spanned: int) -> None:
        nonlocal best
        best = max(best, (matched >= pure * spanned, matched, -spanned))

    for x in st:
        # other text in the place of words of the item is an interruption too
        offer(len(x), _spanned(x) - max((q[0] - p[0] - 1 for p, q in zip(x, x[1:])), default=0))
    for x in st:
        for y in st:
            if x[0][0] < y[0][0] and x[-1][0] < y[-1][0] and x[0][1] < y[0][1] and x[-1][1] < y[-1][1]:
                if len(x) + len(y) < best[1]:
                    continue
                for cut in range(y[0][0], max(x[-1][0] + 1, y[0][0]) + 1):
                    head = [p for p in x if p[0] < cut]
                    tail = [p for p in y if p[0] >= cut and (not head or p[1] > head[-1][1])]
                    offer(len(head) + len(tail), _spanned(head) + _spanned(tail))
    return best[1], -best[2]
