"""Tokenising and text scalars as Catalyst expressions: no Python runs per row.

Null text gives null, empty text an empty array or string, throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.config import CODE_STOPWORDS, ENGLISH_STOPWORDS, MAX_TERM, QUESTION_WORDS

IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
DOTTED = r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"


def _among(c: Column, words: list[str]) -> Column:
    return c.isin(sorted(set(words)))


def identifiers(text: Column) -> Column:
    """All ASCII identifiers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def split_identifier(name: Column) -> Column:
    """Lower-case parts of an identifier: camel case, acronyms and anything not alphanumeric split it."""
    s = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def fold_plural(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("sses"), F.substring(t, F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us") & ~t.endswith("is"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def _undouble(b: Column) -> Column:
    n = F.length(b)
    last, before = F.substring(b, n, F.lit(1)), F.substring(b, n - 1, F.lit(1))
    double = (last == before) & ~last.isin("a", "e", "i", "o", "u") & ~b.endswith("ss") & ~b.endswith("ll") & ~b.endswith("ff")
    return F.when(double, F.substring(b, F.lit(1), n - 1)).otherwise(b)


def fold_verb(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when(t.endswith("ing"), F.when(n - 3 < 4, t).otherwise(_undouble(F.substring(t, F.lit(1), n - 3))))
        .when(t.endswith("ed"), F.when(n - 2 < 4, t).otherwise(_undouble(F.substring(t, F.lit(1), n - 2))))
        .otherwise(t)
    )


def stem(t: Column, verbs: bool = False) -> Column:
    return fold_verb(fold_plural(t)) if verbs else fold_plural(t)


def keep(t: Column) -> Column:
    return F.length(t).between(2, MAX_TERM) & ~_among(t, CODE_STOPWORDS + ENGLISH_STOPWORDS)


def identifier_terms(name: Column, verbs: bool = False) -> Column:
    """The whole identifier, if it has several parts, then its parts; stemmed, stop words dropped."""
    parts = split_identifier(name)
    whole = F.when(F.size(parts) > 1, F.array(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(F.concat(whole, parts), lambda t: stem(t, verbs)), keep)


def terms(text: Column, verbs: bool = False) -> Column:
    """Terms of a block of text, with repetitions: what indexing counts."""
    return F.flatten(F.transform(identifiers(text), lambda x: identifier_terms(x, verbs)))


def path_terms(path: Column, verbs: bool = False) -> Column:
    """Distinct terms of a path: every segment without its extension; not filtered by stop words."""
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"\.[A-Za-z0-9]+\z", ""))
    stems = F.flatten(F.transform(segments, lambda s: F.transform(split_identifier(s), lambda t: stem(t, verbs))))
    return F.array_distinct(F.filter(stems, lambda t: F.length(t) >= 2))


def quoted_spans(question: Column) -> Column:
    """Backticked and double-quoted spans and names written as calls."""
    whole = F.regexp_extract_all(question, F.lit("`([^`]+)`|\"([^\"]+)\"|([A-Za-z_$][A-Za-z0-9_$]*)\\(\\)"), F.lit(0))
    return F.transform(whole, lambda s: F.trim(F.when(s.endswith("()"), F.substring(s, F.lit(1), F.length(s) - 2)).otherwise(F.substring(s, F.lit(2), F.length(s) - 2))))


def looks_like_identifier(token: Column, quoted: Column) -> Column:
    return quoted | token.contains("_") | token.contains(".") | token.rlike("[a-z][A-Z]") | token.rlike("^[A-Z][a-z]+[A-Z]")


def _question_tokens(question: Column) -> Column:
    quoted = quoted_spans(question)
    tokens = F.transform(
        F.regexp_extract_all(question, F.lit(DOTTED), F.lit(0)), lambda t: F.struct(t.alias("t"), F.array_contains(quoted, t).alias("q"))
    )
    return F.filter(tokens, lambda s: s["q"] | ~_among(F.lower(s["t"]), QUESTION_WORDS))


def question_terms(question: Column, verbs: bool = False) -> Column:
    """Distinct search terms of a question, in its order."""
    parts = F.flatten(F.transform(_question_tokens(question), lambda s: F.split(s["t"], r"\.")))
    found = F.flatten(F.transform(parts, lambda p: identifier_terms(p, verbs)))
    return F.array_distinct(F.filter(found, lambda t: ~_among(t, QUESTION_WORDS)))


def question_identifiers(question: Column) -> Column:
    """Distinct tokens that look like names, lower case, whole and in parts."""
    names = F.filter(_question_tokens(question), lambda s: looks_like_identifier(s["t"], s["q"]))
    return F.array_distinct(
        F.flatten(F.transform(names, lambda s: F.concat(F.array(F.lower(s["t"])), F.transform(F.split(s["t"], r"\."), lambda p: F.lower(p)))))
    )


def lines(text: Column) -> Column:
    """Lines of a text; a final line end leaves one empty line."""
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    """Lines of a text; a final line end starts no further line."""
    n = F.size(F.split(text, "\n"))
    return F.when(text == "", 0).when(text.endswith("\n"), n - 1).otherwise(n)


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a text as one text."""
    return F.array_join(F.slice(lines(text), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def fingerprint(text: Column) -> Column:
    """12 hex digits of the SHA-1 of a block."""
    return F.substring(F.sha1(text), 1, 12)


def trim_quote(quote: Column, limit: int = 400) -> Column:
    """The first characters of a long quote, back to a line end if it holds one after its first character."""
    head = F.substring(quote, 1, limit)
    end = F.length(head) - F.instr(F.reverse(head), "\n")
    has = F.instr(head, "\n") > 0
    return F.when(F.length(quote) <= limit, quote).when(has & (end > 0), F.substring(head, F.lit(1), end)).otherwise(head)


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as 2m52.8s or 500ms, rounded up; null if nothing matches."""
    num = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)(ms|h|m|s)"), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)(ms|h|m|s)"), F.lit(2))
    scale = lambda u: F.when(u == "h", 3_600_000.0).when(u == "m", 60_000.0).when(u == "s", 1_000.0).otherwise(1.0)
    total = F.aggregate(F.zip_with(num, unit, lambda n, u: n.cast("double") * scale(u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(num) > 0, F.ceil(total).cast("bigint"))


def package_of(specifier: Column) -> Column:
    """Package name of an import specifier: two segments if scoped, else one."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))


def squeezed(text: Column) -> Column:
    """Text with every run of white space as one blank, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def quote_is_verbatim(quote: Column, block: Column) -> Column:
    """Whether a quote, without line prefixes and apart from white space, stands in a block as one passage."""
    q = squeezed(F.array_join(F.transform(F.split(quote, "\n"), lambda x: F.regexp_replace(x, r"^L\d+\|\s?", "")), " "))
    return (F.length(q) >= 3) & squeezed(block).contains(q)


def permalink(repo: Column, sha: Column, path: Column, first: Column, last: Column) -> Column:
    """Link to lines of a file at a commit; every segment of the path is percent-encoded."""
    enc = F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
    return F.concat(F.lit("/"), repo, F.lit("/blob/"), sha, F.lit("/"), enc, F.lit("#L"), first.cast("string"), F.lit("-L"), last.cast("string"))


def excerpt(text: Column, most_lines: int = 40, width: int = 140) -> Column:
    """The first lines of a text, each cut to a width and numbered."""
    return F.array_join(
        F.transform(F.slice(lines(text), 1, most_lines), lambda x, i: F.concat((i + 1).cast("string"), F.lit("| "), F.substring(x, 1, width))), "\n"
    )


def quoted_lines(block: Column, first: Column, quote: Column) -> Column:
    """(from_line, to_line) of the lines of a block that a quote covers, or null.

    The quote is one passage apart from white space; of several places the first counts, and the
    shortest run of lines that holds it.
    """
    q = squeezed(F.array_join(F.transform(F.split(quote, "\n"), lambda x: F.regexp_replace(x, r"^L\d+\|\s?", "")), " "))
    rows = F.transform(lines(block), squeezed)
    n = F.size(rows)
    joined = lambda a, b: F.array_join(F.filter(F.slice(rows, a, b - a + 1), lambda x: x != ""), " ")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(rows, i) != "")
    begins = lambda i: (F.instr(joined(i, n), q) > 0) & (F.instr(joined(i, n), q) <= F.length(F.element_at(rows, i)))
    start = F.try_element_at(F.filter(starts, begins), F.lit(1))
    end = F.try_element_at(F.filter(F.sequence(F.coalesce(start, F.lit(1)), n), lambda j: F.contains(joined(F.coalesce(start, F.lit(1)), j), q)), F.lit(1))
    return F.when((F.length(q) >= 3) & start.isNotNull(), F.struct((first + start - 1).alias("from_line"), (first + end - 1).alias("to_line")))


def cache_name(key: Column) -> Column:
    """File name of a cache entry."""
    return F.sha2(key, 256)
