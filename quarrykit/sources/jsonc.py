"""JSON with comments and trailing commas, and the string leaves of nested values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\"(?:[^\"\\]|\\.)*\"|//[^\n]*|/\*[\s\S]*?\*/|,(?=(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*[}\]])")


def strip(text: str) -> str:
    """The text without comments and trailing commas; strings are left alone."""
    return _PART.sub(lambda m: m[0] if m[0][0] == '"' else "", text)


def plain_json(text: Column) -> Column:
    """Standard JSON of a JSON-with-comments column, or null if it does not parse."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for t in s:
                try:
                    out.append(json.dumps(json.loads(strip(t.lstrip("﻿")))) if t is not None else None)
                except (ValueError, RecursionError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(text)


def leaves(value) -> list[str]:
    """All strings of a nested value, in order."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    return []


def string_leaves(text: Column) -> Column:
    """All strings of a JSON column, in order; null if it does not parse."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            try:
                out.append(leaves(json.loads(t)) if t is not None else None)
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def _parsed(text: str | None):
    try:
        value = json.loads(strip(text.lstrip("\ufeff"))) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


# Places of a manifest that declare entries, in order.
DECLARED = ["main", "module", "browser", "bin", "exports"]


def targets(manifest: dict) -> list[dict]:
    """kind and target of all that a manifest declares, leaves of nested values in order; ``browser`` counts only as a string."""
    out = []
    for kind in DECLARED:
        value = manifest.get(kind)
        if kind == "browser" and not isinstance(value, str) or kind == "bin" and not isinstance(value, (str, dict)):
            continue
        out += [{"kind": kind, "target": t} for t in leaves(value)]
    return out


def manifest(text: Column) -> Column:
    """name (empty if it is no string) and declared targets of a package manifest; null if it does not parse."""

    @F.pandas_udf("name string, targets array<struct<kind:string,target:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            m = _parsed(t)
            name = m.get("name") if m is not None else None
            rows.append((None, None) if m is None else (name if isinstance(name, str) else "", targets(m)))
        return pd.DataFrame(rows, columns=["name", "targets"])

    return run(text)


def path_rules(text: Column) -> Column:
    """base_url and (pattern, target) rules in order of a compiler configuration; null if it has neither or does not parse."""

    @F.pandas_udf("base_url string, rules array<struct<pattern:string,target:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            o = (_parsed(t) or {}).get("compilerOptions")
            o = o if isinstance(o, dict) else {}
            base = o.get("baseUrl") if isinstance(o.get("baseUrl"), str) and o.get("baseUrl") else None
            paths = o.get("paths") if isinstance(o.get("paths"), dict) else {}
            rules = [{"pattern": k, "target": x} for k, v in paths.items() if isinstance(v, list) for x in v if isinstance(x, str)]
            rows.append((base, rules))
        return pd.DataFrame(rows, columns=["base_url", "rules"])

    return run(text)
