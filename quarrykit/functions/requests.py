"""Validation of request fields and safe projections of what may be logged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions import paths as P

# What may be logged, and the headers that may be kept.
SAFE = r"^[A-Za-z0-9_:.-]{1,60}\z"
LIMIT_HEADERS = [
    "retry-after", "x-ratelimit-limit-requests", "x-ratelimit-limit-tokens", "x-ratelimit-remaining-requests", "x-ratelimit-remaining-tokens", "x-ratelimit-reset-requests", "x-ratelimit-reset-tokens",
]


def search_problem(repo: Column, sha: Column, question: Column, longest: int = 300) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(blank(repo) | blank(sha) | blank(question), "missing")
        .when(F.length(question) > longest, "question too long")
        .when(~P.is_repo_ref(repo), "not a repository")
        .when(~P.is_sha(sha), "not a commit")
    )


def range_problem(path: Column, start: Column, end: Column, most: int = 400) -> Column:
    """Problem of a request for lines; start and end are text as given."""
    number = lambda c: c.rlike(r"^[1-9]\d{0,6}\z")
    a, b = F.try_cast(start, "int") if hasattr(F, "try_cast") else start.try_cast("int"), F.try_cast(end, "int") if hasattr(F, "try_cast") else end.try_cast("int")
    return (
        F.when(F.coalesce(path, F.lit("")).eqNullSafe("") | start.isNull() | end.isNull(), "missing")
        .when(P.archive_path_reason(path).isNotNull(), "not a path")
        .when(~number(start) | ~number(end), "not a line number")
        .when(b < a, "reversed")
        .when(b - a + 1 > most, "too many lines")
    )


def safe_value(c: Column) -> Column:
    return F.when(c.rlike(SAFE), c)


def limit_headers(headers: Column) -> Column:
    """The known rate-limit headers whose values are plain."""
    return F.map_filter(headers, lambda k, v: k.isin(LIMIT_HEADERS) & v.rlike(r"^[A-Za-z0-9_.:+\- ]{1,64}\z"))


def client_key(forwarded: Column) -> Column:
    """Last address of a forwarded-for list if it looks like one."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.when(last.rlike(r"^[0-9A-Fa-f:.]{3,45}\z"), last)


def followed_link(url: Column) -> Column:
    """A link if it leads to the one site that links may lead to, else null."""
    return F.when(url.startswith("https://github.com/"), url)


def is_json(content_type: Column) -> Column:
    """Whether a content type is JSON, plain or of a vendor; an unknown one is not."""
    return F.coalesce(content_type.rlike(r"(?i)^application/(?:[A-Za-z0-9_.+-]+\+)?json\s*(?:;|\z)"), F.lit(False))


def short_quote(quote: Column, least: int = 20) -> Column:
    return F.length(F.regexp_replace(quote, r"\s+", "")) < least


def allowed_host(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(hosts) & url.startswith("https://"), F.lit(False))


def excerpt_lines(text: Column, first: Column, last: Column, width: int = 2_000) -> Column:
    """(lines, cut): lines of a range, each at most ``width`` characters, and how many were cut."""
    from quarrykit.functions.text import lines

    part = F.slice(lines(text), first, F.greatest(last - first + 1, F.lit(0)))
    return F.struct(F.transform(part, lambda x: F.substring(x, 1, width)).alias("lines"), F.size(F.filter(part, lambda x: F.length(x) > width)).alias("cut"))
