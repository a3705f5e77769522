"""Archives (gzipped tar) as a table of entries, with limits enforced while streaming.

One task reads one archive; a tar stream cannot be split.  Content is read only of entries
whose path is kept.

Defined results: an archive over a limit gives the entries before it and one row with outcome
"limit" naming the limit; a damaged archive gives one row with outcome "damaged"; an entry that is
no file, is refused, skipped or too large has a row without content.
"""

from __future__ import annotations

import io
import re
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit import config as C

SCHEMA = "archive STRING, entry_no INT, raw_path STRING, path STRING, outcome STRING, reason STRING, size_bytes BIGINT, content STRING"


@dataclass(frozen=True)
class Limits:
    compressed: int = 150_000_000
    uncompressed: int = 600_000_000
    entries: int = 150_000
    file: int = 1_000_000


class _Bounded(io.RawIOBase):
    """Decompresses a gzip byte string and stops at the limit of unpacked bytes."""

    def __init__(self, data: bytes, most: int):
        self.z, self.data, self.pos, self.out, self.total, self.most = zlib.decompressobj(31), data, 0, b"", 0, most

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        while (n < 0 or len(self.out) < n) and not self.z.eof:
            chunk = self.data[self.pos : self.pos + 65_536]
            self.pos += len(chunk)
            got = self.z.decompress(self.z.unconsumed_tail + chunk, 262_144)
            if not got and not chunk and not self.z.unconsumed_tail:
                if not self.z.eof:
                    raise EOFError("truncated")
                break
            self.total += len(got)
            if self.total > self.most:
                raise OverflowError("uncompressed-bytes")
            self.out += got
        r, self.out = (self.out, b"") if n < 0 else (self.out[:n], self.out[n:])
        return r


def path_reason(raw: str) -> str | None:
    """Why a path is refused; the order of the checks counts."""
    if not raw:
        return "empty"
    if len(raw) > C.MAX_PATH:
        return "too-long"
    if "\0" in raw:
        return "null-byte"
    if "\\" in raw:
        return "backslash"
    if raw.startswith("/") or re.match("[A-Za-z]:", raw):
        return "absolute"
    parts = raw.split("/")
    if ".." in parts or not [p for p in parts if p not in ("", ".")]:
        return "traversal"
    return None


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def is_config(path: str) -> bool:
    return _base(path) in C.CONFIG_FILES or bool(re.search(r"^tsconfig..+.json\Z", _base(path)))


def skip_reason(path: str, include_config: bool = True) -> str | None:
    base = _base(path)
    dot = base.rfind(".")
    ext = base[dot + 1 :].lower() if dot > 0 else ""
    if set(path.split("/")[:-1]) & set(C.VENDORED_DIRS):
        return "vendored"
    if base in C.LOCKFILES:
        return "lockfile"
    if include_config and is_config(path):
        return None
    if re.search(r"(?i)\.min\.[a-z]+\Z|\.(?:map|snap)\Z|\.bundle\.[a-z]+\Z", base):
        return "minified-name"
    if ext in C.BINARY_EXTENSIONS:
        return "binary-extension"
    if is_config(path) or not any(ext in x for x in C.LANGUAGE_EXTENSIONS.values()):
        return "unsupported-extension"
    return None


def read_archive(name: str, data: bytes, limits: Limits = Limits(), include_config: bool = True) -> Iterator[tuple]:
    """Rows of one archive in the order of its entries."""
    no = 0
    row = lambda raw, path, outcome, reason, size, text=None: (name, no, raw, path, outcome, reason, size, text)
    if len(data) > limits.compressed:
        yield row(None, None, "limit", "compressed-bytes", len(data))
        return
    try:
        with tarfile.open(fileobj=_Bounded(data, limits.uncompressed), mode="r|") as tar:
            for m in tar:
                no += 1
                if no > limits.entries:
                    yield row(None, None, "limit", "entries", None)
                    return
                raw = m.name + ("/" if m.isdir() and not m.name.endswith("/") else "")
                if not m.isfile():
                    yield row(raw, None, "not-a-file", None, m.size)
                    continue
                below = raw.split("/", 1)[1] if "/" in raw and not raw.startswith("/") else None
                why = path_reason(raw) or ("no-root" if below is None else path_reason(below))
                if why:
                    yield row(raw, None, "rejected", why, m.size)
                    continue
                path = "/".join(p for p in below.split("/") if p not in ("", "."))
                why = skip_reason(path, include_config) or ("too-large" if m.size > limits.file else None)
                if why:
                    yield row(raw, path, "skipped", why, m.size)
                    continue
                body = tar.extractfile(m).read()
                if b"\0" in body[:8_000]:
                    yield row(raw, path, "skipped", "binary-content", m.size)
                    continue
                text = body.decode("utf-8", "replace")
                if re.search(r"(?i)@generated|DO NOT EDIT|auto-?generated|This file (?:was|is) generated", text[:600]):
                    yield row(raw, path, "skipped", "generated", m.size)
                    continue
                probe = body[:200_000]
                if not path.endswith((".md", ".mdx")) and len(probe) / (probe.count(b"\n") + 1) > 200:
                    yield row(raw, path, "skipped", "minified-content", m.size)
                    continue
                yield row(raw, path, "delivered", None, m.size, text)
    except OverflowError as e:
        yield row(None, None, "limit", str(e), None)
    except (tarfile.TarError, zlib.error, EOFError, OSError):
        yield row(None, None, "damaged", None, None)


def entries(archives: DataFrame, limits: Limits = Limits(), include_config: bool = True, rows_at_once: int = 500) -> DataFrame:
    """Entries of archives (path, content BINARY), a batch or a stream of the binaryFile source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for name, data in zip(b.path, b.content):
                rows = []
                for r in read_archive(name, data, limits, include_config):
                    rows.append(r)
                    if len(rows) >= rows_at_once:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("path", "content").mapInPandas(run, SCHEMA)


def scan(spark: SparkSession, folder: str, limits: Limits = Limits(), pattern: str = "*.tar.gz") -> DataFrame:
    return entries(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder), limits)


def scan_stream(spark: SparkSession, folder: str, limits: Limits = Limits(), pattern: str = "*.tar.gz") -> DataFrame:
    """Entries of archives as they arrive in a folder."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return entries(raw, limits)


def stats(rows: DataFrame) -> DataFrame:
    """Entries, delivered files and bytes, and counts by outcome and reason, for each archive."""
    return rows.groupBy("archive").agg(
        F.count("*").alias("entries"), F.count_if(F.col("outcome") == "delivered").alias("delivered"),
        F.sum(F.when(F.col("outcome") == "delivered", F.col("size_bytes")).otherwise(0)).alias("delivered_bytes"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "rejected").alias("rejected"),
    )


def reasons(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNotNull()).groupBy("archive", "outcome", "reason").agg(F.count("*").alias("entries"))
