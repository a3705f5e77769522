"""Problem 5: items of more lines than a limit are cut into pieces at natural boundaries.

Recursive bisection: an item is cut at the strongest boundary near its midpoint, and halves
that still exceed the limit less the overlap are cut again; then every piece but the first is
extended upwards by the overlap.

Defined results: an item without start_line or end_line, of an unknown file, or whose part that exists has
at most the limit is no case; start_line below 1 counts as 1; null content has no lines; repeated
rows give one result; equally strong boundaries are decided by the shorter way to the midpoint,
then by the smaller line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.session import spread

LIMIT, OVERLAP = 80, 5
_MASKED = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|([{(\[])|([})\]])|(\n)"
)
_OPENS = re.compile(
    r"\s*(?:export\b|import\b|(?:async\s+)?function\b|class\b|const\b|let\b|var\b|interface\b|type\b|enum\b|namespace\b|abstract\b|public\b|private\b|protected\b|static\b"
    r"|if\b|for\b|while\b|switch\b|case\b|default\b|try\b|return\b|describe\(|it\(|test\(|[A-Za-z_$][\w$]*\s*\(.*\)\s*\{|#{1,6}\s|/\*\*|//|@)"
)


def line_count(content: Column) -> Column:
    """Lines of a text: a final line end starts no further line."""
    ends = F.length(content) - F.length(F.regexp_replace(content, "\n", ""))
    return F.when(content.isNull() | (content == ""), 0).otherwise(ends + F.when(content.endswith("\n"), 0).otherwise(1)).cast("int")


def strengths(text: str) -> np.ndarray:
    """For each line, how natural a cut after it is: 0 inside a comment or literal, more for shallow nesting,
    more after a blank line, the end of a block, or before the start of a statement or member."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    n = len(lines)
    depth = np.zeros(n, np.int32)
    inside = np.zeros(n, bool)
    d = line = 0
    for m in _MASKED.finditer(text):
        if m[1]:
            d += 1
        elif m[2]:
            d = max(0, d - 1)
        elif m[3]:
            if line < n:
                depth[line] = d
            line += 1
        else:
            for _ in range(m[0].count("\n")):
                if line < n:
                    depth[line] = d
                    inside[line] = True
                line += 1
    out = np.zeros(n, np.int16)
    for i in range(n - 1):
        if inside[i]:
            continue
        s = 40 - 6 * min(int(depth[i]), 6)
        here, after = lines[i].strip(), lines[i + 1]
        if not here:
            s += 9
        elif here[-1] in "};" or here.endswith((");", "},")):
            s += 5
        elif here[-1] in ",({[=+&|?:.":
            s -= 3
        if not after.strip():
            s += 2
        elif _OPENS.match(after):
            s += 4
        elif after.strip()[0] in "})].":
            s -= 4
        out[i] = max(s, 1)
    return out


def pieces(strength, start: int, end: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces (first and last line) of the item start..end; strength[i] belongs to the cut after line start + i.

    A cut is looked for within a quarter of the part's length around its middle; its strength is
    lowered by the way to the middle, so that of two alike the nearer wins.
    """
    if end - start + 1 <= limit:
        return [(start, end)]
    room = max(1, limit - overlap)
    cores: list[tuple[int, int]] = []
    stack = [(start, end)]
    while stack:
        a, b = stack.pop()
        n = b - a + 1
        if n <= (limit if a == start else room):
            cores.append((a, b))
            continue
        middle, reach = a + n // 2 - 1, max(1, n // 4)
        if n <= 2 * room:
            reach = min(reach, max(1, room - (n + 1) // 2))
        lo, hi = max(a, middle - reach), min(b - 1, middle + reach)
        cut = max(range(lo, hi + 1), key=lambda i: (float(strength[i - start]) - 8.0 * abs(i - middle) / (reach + 1), -abs(i - middle), -i))
        stack.append((cut + 1, b))
        stack.append((a, cut))
    return [(a if a == start else max(start, a - overlap), b) for a, b in cores]


def items(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    s = symbols.select(F.lit("symbol").alias("item_kind"), F.col("symbol_id").alias("item_id"), "file_id", "repo", "start_line", "end_line")
    c = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "file_id", "repo", "start_line", "end_line")
    return s.unionByName(c)


def oversized(files: DataFrame, symbols: DataFrame, chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Items of which more than the limit's lines exist, with the last line that exists."""
    long = items(symbols, chunks).withColumn("start_line", F.greatest("start_line", F.lit(1)))
    long = long.where(F.col("end_line") - F.col("start_line") + 1 > limit).dropDuplicates(["item_kind", "item_id"])
    lines = files.select("file_id", line_count(F.col("content")).alias("lines")).where(F.col("lines") > limit).dropDuplicates(["file_id"])
    return long.join(lines, "file_id").withColumn("last_line", F.least("end_line", "lines")).where(F.col("last_line") - F.col("start_line") + 1 > limit).drop("lines")


def _strength_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"file_id": b.file_id, "strength": [strengths(t).tolist() for t in b.content]})


def split_items(files: DataFrame, symbols: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: item_kind, item_id, file_id, repo, piece_no from 0, first and last line.

    The boundaries of a file are computed once; each item takes its own slice of them from the
    join, so a file with very many items is an ordinary skewed equi-join and nothing is
    gathered by file.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    big = oversized(files, symbols, chunks, limit)
    text = files.select("file_id", "content").where(line_count(F.col("content")) > limit).dropDuplicates(["file_id"])
    text = text.join(big.select("file_id").distinct(), "file_id", "left_semi")
    marks = spread(text, "file_id").mapInPandas(_strength_batches, "file_id BIGINT, strength ARRAY<SMALLINT>")
    own = big.join(marks, "file_id").withColumn("strength", F.expr("slice(strength, start_line, last_line - start_line + 1)"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, i, f, repo, first, last, st in zip(b.item_kind, b.item_id, b.file_id, b.repo, b.start_line, b.last_line, b.strength):
                for no, (x, y) in enumerate(pieces(st, int(first), int(last), limit, overlap)):
                    rows.append((kind, i, f, repo, no, x, y))
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "file_id", "repo", "piece_no", "first_line", "last_line"])

    return own.select("item_kind", "item_id", "file_id", "repo", "start_line", "last_line", "strength").mapInPandas(
        cut, "item_kind STRING, item_id BIGINT, file_id BIGINT, repo STRING, piece_no INT, first_line INT, last_line INT"
    )


def found_items(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items that were split: those with a second piece."""
    return split_items(files, symbols, chunks).where("piece_no = 1").select("item_kind", "item_id")
