"""The text expressions of ``functions`` in the SQL dialect of the checking engine."""

from __future__ import annotations

from quarrykit import config as C


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


IDENT = "'[A-Za-z_$][A-Za-z0-9_$]*'"


def identifiers(x: str) -> str:
    return f"regexp_extract_all({x}, {IDENT})"


def split_identifier(x: str) -> str:
    s = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower(regexp_replace({s}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda s_: s_ <> '')"


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND ends_with({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' WHEN length({t}) > 4 AND ends_with({t}, 'sses') THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') AND NOT ends_with({t}, 'us') AND NOT ends_with({t}, 'is') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def keep(t: str) -> str:
    return f"(length({t}) BETWEEN 2 AND {C.MAX_TERM} AND {t} NOT IN ({quoted(C.CODE_STOPWORDS + C.ENGLISH_STOPWORDS)}))"


def identifier_terms(x: str) -> str:
    parts = split_identifier(x)
    whole = f"CASE WHEN len({parts}) > 1 THEN [regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')] ELSE CAST([] AS VARCHAR[]) END"
    return f"list_filter(list_transform(list_concat({whole}, {parts}), lambda t_: {stem('t_')}), lambda k_: {keep('k_')})"


def postings(table: str, keys: str, text: str = "text") -> str:
    """keys, term, tf of a table as a sub-query."""
    return (
        f"(SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest({identifier_terms('id')}) AS term FROM "
        f"(SELECT {keys}, unnest({identifiers(text)}) AS id FROM {table})) GROUP BY {keys}, term)"
    )


def question_tokens(q: str) -> str:
    spans = f"regexp_extract_all({q}, '`[^`]+`|\"[^\"]+\"|[A-Za-z_$][A-Za-z0-9_$]*\\(\\)')"
    quoted_ = f"list_transform({spans}, lambda s_: trim(CASE WHEN ends_with(s_, '()') THEN left(s_, length(s_) - 2) ELSE substr(s_, 2, length(s_) - 2) END))"
    return f"{quoted_} AS quoted_, regexp_extract_all({q}, '[A-Za-z_$][A-Za-z0-9_$]*(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*') AS tokens_"


def question_terms(table: str, key: str, q: str) -> str:
    """key, pos, term: distinct terms of a question; pos orders them."""
    words = quoted(C.QUESTION_WORDS)
    return f"""(SELECT {key}, term, min(a * 1000000 + b * 1000 + c) AS pos FROM (
  SELECT {key}, a, b, unnest(ts) AS term, generate_subscripts(ts, 1) AS c FROM (
    SELECT {key}, a, b, {identifier_terms('part')} AS ts FROM (
      SELECT {key}, a, unnest(ps) AS part, generate_subscripts(ps, 1) AS b FROM (
        SELECT {key}, a, string_split(t, '.') AS ps FROM (
          SELECT {key}, quoted_, unnest(tokens_) AS t, generate_subscripts(tokens_, 1) AS a FROM (SELECT {key}, {question_tokens(q)} FROM {table}))
        WHERE list_contains(quoted_, t) OR lower(t) NOT IN ({words})))))
  WHERE term NOT IN ({words}) GROUP BY {key}, term)"""


def question_identifiers(table: str, key: str, q: str) -> str:
    """key, name, pos: distinct tokens of a question that look like names, whole and in parts; pos orders them."""
    return f"""(SELECT {key}, name, min(a * 1000 + b) AS pos FROM (SELECT {key}, a, unnest(ps) AS name, generate_subscripts(ps, 1) AS b FROM (SELECT {key}, a, list_concat([lower(t)], string_split(lower(t), '.')) AS ps FROM (
  SELECT {key}, quoted_, unnest(tokens_) AS t, generate_subscripts(tokens_, 1) AS a FROM (SELECT {key}, {question_tokens(q)} FROM {table}))
  WHERE list_contains(quoted_, t) OR (lower(t) NOT IN ({quoted(C.QUESTION_WORDS)}) AND (contains(t, '_') OR contains(t, '.') OR regexp_matches(t, '[a-z][A-Z]') OR regexp_matches(t, '^[A-Z][a-z]+[A-Z]'))))) GROUP BY {key}, name)"""


def path_terms(table: str, keys: str, path: str) -> str:
    """keys, term: distinct terms of paths."""
    return (
        f"(SELECT DISTINCT {keys}, term FROM (SELECT {keys}, {stem('t')} AS term FROM (SELECT {keys}, unnest({split_identifier("regexp_replace(seg, '[.][A-Za-z0-9]+$', '')")}) AS t FROM "
        f"(SELECT {keys}, unnest(string_split({path}, '/')) AS seg FROM {table}))) WHERE length(term) >= 2)"
    )


def base_name(p: str) -> str:
    return f"list_last(string_split({p}, '/'))"


def dirs(p: str) -> str:
    return f"string_split({p}, '/')[1:-2]"


def extension_of(p: str) -> str:
    b = base_name(p)
    return f"CASE WHEN instr(reverse({b}), '.') IN (0, length({b})) THEN '' ELSE lower(right({b}, instr(reverse({b}), '.') - 1)) END"


def is_config(p: str) -> str:
    return f"({base_name(p)} IN ({quoted(C.CONFIG_FILES)}) OR regexp_matches({base_name(p)}, '^tsconfig..+.json$'))"


def language_of(p: str) -> str:
    cases = " ".join(f"WHEN {extension_of(p)} IN ({quoted(e)}) THEN '{k}'" for k, e in C.LANGUAGE_EXTENSIONS.items())
    return f"CASE WHEN {is_config(p)} THEN 'config' {cases} ELSE 'other' END"


def any_dir(p: str, names) -> str:
    return f"len(list_filter({dirs(p)}, lambda d_: d_ IN ({quoted(names)}))) > 0"


def skip_reason(p: str) -> str:
    b = base_name(p)
    return (
        f"CASE WHEN {any_dir(p, C.VENDORED_DIRS)} THEN 'vendored' WHEN {b} IN ({quoted(C.LOCKFILES)}) THEN 'lockfile' WHEN {is_config(p)} THEN NULL "
        f"WHEN regexp_matches({b}, '(?i)\\.min\\.[a-z]+$|\\.(map|snap)$|\\.bundle\\.[a-z]+$') THEN 'minified-name' "
        f"WHEN {extension_of(p)} IN ({quoted(C.BINARY_EXTENSIONS)}) THEN 'binary-extension' WHEN {language_of(p)} IN ('other', 'config') THEN 'unsupported-extension' END"
    )


def file_class(p: str) -> str:
    b = base_name(p)
    return (
        f"CASE WHEN {is_config(p)} THEN 'config' WHEN {any_dir(p, C.TEST_DIRS)} OR regexp_matches({b}, '(?i)\\.(test|spec)\\.[a-z]+$|^test[-_.]') THEN 'test' "
        f"WHEN {any_dir(p, C.EXAMPLE_DIRS)} OR len(list_filter({dirs(p)}, lambda d_: starts_with(d_, 'template-'))) > 0 THEN 'example' "
        f"WHEN {any_dir(p, C.DOCS_DIRS)} OR regexp_matches({b}, '(?i)\\.mdx?$') THEN 'docs' ELSE 'source' END"
    )


def line_count(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, chr(10))) - CASE WHEN ends_with({t}, chr(10)) THEN 1 ELSE 0 END END"


FILES = "(SELECT DISTINCT ON (file_id) file_id, build_id, repo, sha, path, coalesce(content, '') AS content FROM ingested_files)"
CHUNKS = f"""(SELECT c.chunk_id, c.file_id, c.repo, f.path, f.sha, c.start_line, least(coalesce(c.end_line, n), n) AS end_line,
  array_to_string(string_split(f.content, chr(10))[c.start_line:least(coalesce(c.end_line, n), n)], chr(10)) AS text
  FROM (SELECT DISTINCT ON (chunk_id) * FROM extracted_chunks) c JOIN (SELECT *, {line_count('content')} AS n FROM {FILES}) f USING (file_id)
  WHERE c.start_line <= least(coalesce(c.end_line, n), n))"""
QUESTIONS = (
    "(SELECT DISTINCT ON (question_id) question_id, trim(regexp_replace(trim(lower(repo)), '\\.git\\s*$', '')) AS repo, category, question, expected, absent_terms, added_at FROM questions)"
)


def bm25(blocks: str, block: str, corpus: str, terms: str, query: str, k1: float = 1.2, b: float = 0.75) -> str:
    """WITH part ending in ``hits`` (corpus, query, block, term, weight).  blocks and terms are names of CTEs."""
    on = f"USING ({corpus})" if corpus else "ON true"
    c = f"{corpus}, " if corpus else ""
    g = f"GROUP BY {corpus}" if corpus else ""
    join = f"({corpus}, term)" if corpus else "(term)"
    both = f"({corpus}, {block})" if corpus else f"({block})"
    return f"""post AS (SELECT * FROM {postings(blocks, c + block)}),
len AS (SELECT {c}{block}, sum(tf) AS term_count FROM post GROUP BY {c}{block}),
st AS (SELECT {c}count(*) AS blocks, avg(coalesce(term_count, 0)) AS mean_length FROM {blocks} LEFT JOIN len USING {both} {g}),
df AS (SELECT {c}term, count(*) AS df FROM post GROUP BY {c}term),
hits AS (SELECT {c}{query}, {block}, term, ln(1.0 + (blocks - df + 0.5) / (df + 0.5)) * (tf * ({k1} + 1)) / (tf + {k1} * (1 - {b} + {b} * term_count / CASE WHEN mean_length > 0 THEN mean_length ELSE 1.0 END)) AS weight
  FROM {terms} JOIN df USING {join} JOIN post USING {join} JOIN len USING {both} JOIN st {on})"""
