"""Queries of the eight training-data problems: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrykit.llm import boundaries, handwritten, leakage, nearsplit, packing, secrets, subjects, syntax
from quarrykit.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _of(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: f(*[table(spark, d, n) for n in names])


_SPLIT = ("questions", "support", "repos")
_ITEMS = ("ingested_files", "extracted_symbols", "extracted_chunks")
_AREAS = ("documents", "doc_labels", "subjects", "eval_passages")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _of(syntax.invalid_files, "ingested_files"),
        "p1_errors": _of(syntax.parse_files, "ingested_files"),
        "p1_rates": _of(syntax.rates, "ingested_files"),
        "p1_reported": _of(syntax.against_reports, "ingested_files", "built_indexes"),
        "p2_found": _of(handwritten.not_handwritten, "ingested_files"),
        "p2_reasons": _of(handwritten.classified, "ingested_files"),
        "p2_composition": _of(handwritten.composition, "ingested_files"),
        "p3_found": _of(nearsplit.found_pairs, *_SPLIT),
        "p3_counts": _of(nearsplit.counts, *_SPLIT),
        "p4_found": _of(secrets.found_lines, "ingested_files"),
        "p4_findings": _of(secrets.findings, "ingested_files"),
        "p4_redacted": _of(secrets.redacted, "ingested_files"),
        "p5_found": _of(boundaries.found_items, *_ITEMS),
        "p5_pieces": _of(boundaries.split_items, *_ITEMS),
        "p6_packed": _of(packing.packed, "documents"),
        "p6_usage": _of(packing.usage, "documents"),
        "p7_found": _of(leakage.found, "documents", "eval_passages"),
        "p7_items": _of(leakage.leaked_items, "documents", "eval_passages"),
        "p8_found": lambda s, d: subjects.document_subjects(*[table(s, d, n) for n in _AREAS]).select("doc_id", "subject"),
        "p8_shares": _of(subjects.shares, *_AREAS),
        "p8_composition": _of(subjects.composition, *_AREAS),
    }
