"""Problem 4: credentials embedded in source files.

``scan`` decodes base64, hex, percent and escape layers recursively, parses key containers
by their binary grammar and rescans what it decoded; redaction masks the enclosing literal.

Defined results: null or empty content has no finding and is returned as it is; a null path is
treated as any other; repeated rows give one row; overlapping findings are one; a line is
counted by "\\n" from 1; a file with several findings on one line has one row for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.secretscan import redact, scan
from quarrykit.session import spread

FINDINGS = "file_id BIGINT, repo STRING, path STRING, line_no INT, start_pos INT, end_pos INT, kind STRING, layers INT"
REDACTED = "file_id BIGINT, repo STRING, path STRING, findings INT, content STRING"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file_id", "repo", "path", "line_no", "start_pos", "end_pos", "kind", "layers"]
    for b in batches:
        rows = []
        for i, repo, path, text in zip(b.file_id, b.repo, b.path, b.content):
            for a, z, kind, layers in scan(text or ""):
                rows.append((i, repo, path, text.count("\n", 0, a) + 1, a, z, kind, layers))
        yield pd.DataFrame(rows, columns=names)


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [scan(t or "") for t in b.content]
        yield pd.DataFrame(
            {
                "file_id": b.file_id,
                "repo": b.repo,
                "path": b.path,
                "findings": [len(f) for f in found],
                "content": [redact(t, f) if t else t for t, f in zip(b.content, found)],
            }
        )


def findings(files: DataFrame) -> DataFrame:
    """Every credential: file, line, offsets in characters, kind and layers of encoding."""
    source = spread(files.select("file_id", "repo", "path", "content").where(F.col("content") != ""))
    return source.mapInPandas(_find, FINDINGS).distinct()


def found_lines(files: DataFrame) -> DataFrame:
    source = spread(files.select("file_id", "repo", "path", "content").where(F.col("content") != ""))
    return source.mapInPandas(_find, FINDINGS).select("file_id", "line_no").distinct()


def redacted(files: DataFrame) -> DataFrame:
    """Every file with its credentials masked; text without any is unchanged.

    The texts are the result, so here they are made distinct before they are scanned.
    """
    source = spread(files.select("file_id", "repo", "path", "content"), "file_id").dropDuplicates(["file_id"])
    return source.mapInPandas(_redact, REDACTED)
