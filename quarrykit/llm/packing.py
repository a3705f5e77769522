"""Problem 6: texts are put into containers of a fixed number of tokens.

Bin completion: the largest text left opens a container, the undominated ways to fill it are
tried fullest first, and a branch is given up once its waste exceeds what would still beat the
best solution known; best-fit and first-fit decreasing give the first incumbents.

At scale the texts are spread over groups of bounded size, each packed alone; containers that
are not full enough are opened again and their texts packed in fewer groups, until one group
is left or hardly any more get full.  Only (document, piece, tokens) rows are shuffled.

Defined results: a null or empty text has 0 tokens and still stands in one container; a text over
the capacity is cut into pieces of at most the capacity, between words where it has any;
equal sizes are taken in the order of their ids.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.session import buckets_for, checkpointed, spread

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
GROUP = 800  # items packed together by one search
NODES = 1_500  # nodes of one branch-and-bound search
FULL = 0.995  # a container this full is not opened again

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _tokenizers[path] = t
    return _tokenizers[path]


def cut_points(text: str, tok, capacity: int) -> list[tuple[int, int, int]]:
    """Pieces (first character, end, tokens) of a text, each of at most ``capacity`` tokens.

    A piece ends before a blank that follows a word where the last quarter of the piece has
    one, else between two characters.  The text is encoded once, and every piece again to count its own
    tokens; one that has too many is shortened.
    """
    offsets = tok.encode(text, add_special_tokens=False).offsets
    starts = [a for a, _ in offsets]
    out, pos, n = [], 0, len(text)
    while pos < n or not out:
        first = bisect.bisect_left(starts, pos)
        room = capacity
        while True:
            end = n
            if len(starts) - first > room:
                end = 0
                for i in range(first + room, first + max(1, room * 3 // 4), -1):
                    if text[starts[i]] in " \n\t" and not text[starts[i] - 1].isspace():
                        end = starts[i]
                        break
                if end <= pos:
                    i = first + room
                    while i > first + 1 and starts[i] < offsets[i - 1][1]:
                        i -= 1
                    end = max(pos + 1, starts[i])
            size = len(tok.encode(text[pos:end], add_special_tokens=False).ids)
            if size <= capacity or end == pos + 1:
                break
            room = max(1, min(room, len(starts) - first) - max(1, size - capacity))
        out.append((pos, end, size))
        pos = end
    return out


def sized(documents: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece_no, start_char, end_char and tokens of every text, or of every piece of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for b in batches:
            texts = [t or "" for t in b.text]
            rows = []
            for k in range(0, len(texts), 64):
                for i, t, e in zip(b.doc_id[k : k + 64], texts[k : k + 64], tok.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)):
                    if len(e.ids) <= capacity:
                        rows.append((i, 0, 0, len(t), len(e.ids)))
                    else:
                        rows += [(i, no, x, y, n) for no, (x, y, n) in enumerate(cut_points(t, tok, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_char", "end_char", "tokens"])

    pieces = spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id BIGINT, piece_no INT, start_char INT, end_char INT, tokens INT")
    return pieces.dropDuplicates(["doc_id", "piece_no"])


# ---- one group
def best_fit(sizes: list[int], capacity: int, first: bool = False) -> list[list[int]]:
    """Best-fit (or first-fit) decreasing; returns containers of places in ``sizes``."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    if first:
        room: list[int] = []
        for i in order:
            for b, r in enumerate(room):
                if r >= sizes[i]:
                    bins[b].append(i)
                    room[b] -= sizes[i]
                    break
            else:
                bins.append([i])
                room.append(capacity - sizes[i])
        return bins
    free: list[tuple[int, int]] = []  # (room, container), sorted
    for i in order:
        k = bisect.bisect_left(free, (sizes[i], -1))
        if k < len(free):
            r, b = free.pop(k)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        bisect.insort(free, (r - sizes[i], b))
    return bins


FILLINGS, STEPS = 12, 400  # fillings of one container that are tried, steps that look for them


def dominated(chosen: tuple[int, ...], left: int, others: int) -> bool:
    """Whether a filling is dominated: some of its sizes (or none) could give way to one larger size that is left out
    and still fits (Martello and Toth), or two and more of them to one of the same sum.

    others: bit x is set if a size x is left out.  The sums of all subsets are the bits of a number too, so the
    sums that a size x may replace, x - left to x - 1, meet it after a few shifts.
    """
    any_sum, two_sum = 1, 0
    for s in chosen:
        two_sum |= (two_sum << s) | ((any_sum & ~1) << s)
        any_sum |= any_sum << s
    if two_sum & others:
        return True
    if left <= 0:
        return False
    larger, width = any_sum << 1, 1
    while width < left:
        step = min(width, left - width)
        larger |= larger << step
        width += step
    return bool(larger & others)


def completions(room: int, sizes: list[int], count: dict[int, int], slack: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of a room: multisets of the sizes left, fullest first, as many as ``most`` and ``STEPS`` allow.

    Fillings that waste more than ``slack`` cannot lead to a better solution.  sizes: distinct, falling.
    """
    if count.get(room):
        return [(room,)]
    found: list[tuple[int, tuple[int, ...]]] = []
    smallest = next((s for s in reversed(sizes) if count[s]), None)
    if smallest is None or smallest > room:
        return [()] if room <= slack else []
    steps = 0
    free = 0
    for s in sizes:
        if count[s] and s <= room:
            free |= 1 << s

    def left_out(chosen: tuple[int, ...]) -> int:
        used = 0
        for s in set(chosen):
            if chosen.count(s) >= count[s]:
                used |= 1 << s
        return free & ~used

    def extend(k: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps
        steps += 1
        if steps > STEPS or len(found) >= 4 * most:
            return
        more = False
        if left >= smallest:
            for j in range(k, len(sizes)):
                s = sizes[j]
                if s <= left and count[s] > chosen.count(s):
                    more = True
                    extend(j, left - s, (*chosen, s))
                    if steps > STEPS:
                        return
        if not more and left <= slack and not dominated(chosen, left, left_out(chosen)):
            found.append((left, chosen))

    extend(bisect.bisect_left([-s for s in sizes], -room), room, ())
    found.sort()
    return [c for _, c in dict.fromkeys(found)][:most]


def pack(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Containers (lists of places in ``sizes``) by bin completion, at most ``nodes`` search nodes."""
    if any(s > capacity for s in sizes):
        raise ValueError("a size exceeds the capacity")
    solid = [i for i, s in enumerate(sizes) if s > 0]
    empty = [i for i, s in enumerate(sizes) if s <= 0]
    best = best_fit([sizes[i] for i in solid], capacity)
    other = best_fit([sizes[i] for i in solid], capacity, True)
    best = [[solid[k] for k in b] for b in (other if len(other) < len(best) else best)]
    total = sum(sizes[i] for i in solid)
    bound = max(-(-total // capacity), sum(2 * sizes[i] > capacity for i in solid))
    if solid and len(best) > bound:
        better = _search([sizes[i] for i in solid], capacity, len(best), bound, nodes)
        if better:
            best = [[solid[k] for k in b] for b in better]
    if empty:
        if not best:
            best = [[]]
        best[0] = best[0] + empty
    return best


def _search(sizes: list[int], capacity: int, known: int, bound: int, nodes: int) -> list[list[int]] | None:
    places: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        places.setdefault(s, []).append(i)
    distinct = sorted(places, reverse=True)
    count = {s: len(p) for s, p in places.items()}
    total = sum(sizes)
    best: list[tuple[int, ...]] | None = None
    limit = known
    chosen: list[tuple[int, ...]] = []
    stack: list[list[tuple[int, ...]]] = []
    used = left = 0
    waste = 0

    def options() -> list[tuple[int, ...]]:
        largest = next(s for s in distinct if count[s])
        count[largest] -= 1
        slack = (limit - 1) * capacity - total - waste
        fills = completions(capacity - largest, distinct, count, slack) if slack >= 0 else []
        count[largest] += 1
        return [(largest, *f) for f in reversed(fills)]

    left = len(sizes)
    stack.append(options())
    while stack and used < nodes:
        used += 1
        if not stack[-1]:
            stack.pop()
            if chosen:
                f = chosen.pop()
                for s in f:
                    count[s] += 1
                left += len(f)
                waste -= capacity - sum(f)
            continue
        f = stack[-1].pop()
        w = capacity - sum(f)
        if left > len(f) and (limit - 1) * capacity - total - waste - w < 0:
            continue
        for s in f:
            count[s] -= 1
        left -= len(f)
        waste += w
        chosen.append(f)
        if not left:
            if len(chosen) < limit:
                best, limit = list(chosen), len(chosen)
                if limit <= bound:
                    break
            chosen.pop()
            for s in f:
                count[s] += 1
            left += len(f)
            waste -= w
            continue
        if len(chosen) >= limit - 1:
            stack.append([])
            continue
        stack.append(options())
    if best is None:
        return None
    taken = {s: list(p) for s, p in places.items()}
    return [[taken[s].pop() for s in f] for f in best]


# ---- all groups
def containers(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nodes: int = NODES) -> DataFrame:
    """container_id, doc_id, piece_no, tokens.  items: doc_id, piece_no, tokens (each at most the capacity)."""

    def packer(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
            number, full = [0] * len(pdf), [True] * len(pdf)
            sizes = pdf.tokens.tolist()
            for no, b in enumerate(pack(sizes, capacity, nodes)):
                ok = last or sum(sizes[i] for i in b) >= FULL * capacity
                for i in b:
                    number[i], full[i] = no, ok
            g = int(pdf.g.iloc[0]) if len(pdf) else 0
            return pd.DataFrame({"doc_id": pdf.doc_id, "piece_no": pdf.piece_no, "tokens": pdf.tokens, "container_id": [f"{level}-{g}-{n}" for n in number], "closed": full})

        return run

    rest = items.select("doc_id", "piece_no", "tokens")
    count = rest.count()
    done = before = None
    level = 0
    while True:
        n = buckets_for(count, group)
        last = n == 1 or before is not None and count > 0.8 * before
        placed = checkpointed(
            spread(rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), F.lit(n))), "g")
            .groupBy("g")
            .applyInPandas(packer(level, last), "doc_id BIGINT, piece_no INT, tokens INT, container_id STRING, closed BOOLEAN")
        )
        closed = placed.where("closed").select("container_id", "doc_id", "piece_no", "tokens")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        rest = placed.where("not closed").select("doc_id", "piece_no", "tokens")
        before, count = count, rest.count()
        level += 1
        if not count:
            return done


def packed(documents: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Every text, or piece of one, with its container and its part of the text."""
    s = checkpointed(sized(documents, path, capacity))
    c = containers(s, capacity)
    return c.join(s.select("doc_id", "piece_no", "start_char", "end_char"), ["doc_id", "piece_no"])


def usage(documents: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the fewest possible by size, tokens, unused room and its share."""
    per = packed(documents, path, capacity).groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return per.agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("tokens") / capacity).alias("fewest_possible"),
        F.sum("tokens").alias("tokens"),
        (F.count("*") * capacity - F.sum("tokens")).alias("unused"),
        F.round(1 - F.sum("tokens") / (F.count("*") * capacity), 6).alias("unused_share"),
        F.max("tokens").alias("fullest"),
    )
