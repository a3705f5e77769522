"""All queries of the core and, where it can be said, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _parts():
    from quarrykit.plans import answers, evaluation, files, fused, graph, planted, requests, retrieval, service, text

    return files, text, retrieval, graph, evaluation, requests, answers, planted, fused, service


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for p in _parts():
        out |= p.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for p in _parts():
        out |= p.SQL
    return out
