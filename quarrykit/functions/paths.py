"""Predicates and classes of paths, files and repository names as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit import config as C


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension_of(path: Column) -> Column:
    """Lower-case suffix after the last dot of the name; empty for none and for dot files."""
    base = base_name(path)
    back = F.instr(F.reverse(base), ".")
    return F.when((back == 0) | (back == F.length(base)), "").otherwise(F.lower(F.right(base, back - 1)))


def is_config_file(path: Column) -> Column:
    base = base_name(path)
    # Fixed value: the dots match any character, as in the indexes to be compared with.
    return base.isin(C.CONFIG_FILES) | base.rlike(r"^tsconfig..+.json\z")


def language_of(path: Column) -> Column:
    ext = extension_of(path)
    out = F.when(is_config_file(path), "config")
    for language, extensions in C.LANGUAGE_EXTENSIONS.items():
        out = out.when(ext.isin(extensions), language)
    return out.otherwise("other")


def skip_reason(path: Column, include_config: bool = True) -> Column:
    """Why a path is not indexed, or null; decided before any content is read."""
    base = base_name(path)
    out = F.when(F.exists(dirs(path), lambda d: d.isin(C.VENDORED_DIRS)), "vendored").when(base.isin(C.LOCKFILES), "lockfile")
    if include_config:
        out = out.when(is_config_file(path), F.lit(None).cast("string"))
    return (
        out.when(base.rlike(r"(?i)\.min\.[a-z]+\z|\.(map|snap)\z|\.bundle\.[a-z]+\z"), "minified-name")
        .when(extension_of(path).isin(C.BINARY_EXTENSIONS), "binary-extension")
        .when(language_of(path).isin("other", "config"), "unsupported-extension")
    )


def content_skip_reason(content: Column, language: Column) -> Column:
    """Why a content is not indexed, or null: binary, generated, or lines of more than 200 characters on average."""
    probe = F.substring(content, 1, 200_000)
    count = F.length(probe) - F.length(F.regexp_replace(probe, "\n", "")) + 1
    return (
        F.when(F.instr(F.substring(content, 1, 8_000), "\x00") > 0, "binary-content")
        .when(F.substring(content, 1, 600).rlike(r"(?i)@generated|DO NOT EDIT|auto-?generated|This file (was|is) generated"), "generated")
        .when((language != "markdown") & (F.length(probe) / count > 200), "minified-content")
    )


def file_class(path: Column) -> Column:
    """config, test, example, docs or source, by the path alone."""
    base, ds = base_name(path), dirs(path)
    return (
        F.when(is_config_file(path), "config")
        .when(F.exists(ds, lambda d: d.isin(C.TEST_DIRS)) | base.rlike(r"(?i)\.(test|spec)\.[a-z]+\z|^test[-_.]"), "test")
        .when(F.exists(ds, lambda d: d.isin(C.EXAMPLE_DIRS) | d.startswith("template-")), "example")
        .when(F.exists(ds, lambda d: d.isin(C.DOCS_DIRS)) | base.rlike(r"(?i)\.mdx?\z"), "docs")
        .otherwise("source")
    )


def wants_non_source(question: Column) -> Column:
    words = "|".join(C.NON_SOURCE_WORDS)
    return question.rlike(rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])")


def entry_intent(question: Column) -> Column:
    # Phrases that announce the intent.
    return question.rlike(
        r"(?i)(?<![A-Za-z0-9_])(entry[- ]?points?|main (file|module)|bin|cli|command[- ]line|start ?up|bootstrap)(?![A-Za-z0-9_])"
    )


def archive_path_reason(raw: Column) -> Column:
    """Why a path of an archive is refused, or null.  The order of the checks counts."""
    return (
        F.when(raw == "", "empty")
        .when(F.length(raw) > C.MAX_PATH, "too-long")
        .when(F.instr(raw, "\x00") > 0, "null-byte")
        .when(F.instr(raw, "\\") > 0, "backslash")
        .when(raw.startswith("/") | raw.rlike("^[A-Za-z]:"), "absolute")
        .when(F.array_contains(F.split(raw, "/"), ".."), "traversal")
        .when(F.size(F.filter(F.split(raw, "/"), lambda s: ~s.isin("", "."))) == 0, "traversal")
    )


def archive_path(raw: Column) -> Column:
    """The path without '.' and empty segments; null where it is refused."""
    clean = F.array_join(F.filter(F.split(raw, "/"), lambda s: ~s.isin("", ".")), "/")
    return F.when(archive_path_reason(raw).isNull(), clean)


def strip_root(raw: Column) -> Column:
    return F.when(F.instr(raw, "/") > 0, F.substring(raw, F.instr(raw, "/") + 1, F.length(raw)))


def joined_path(directory: Column, rel: Column) -> Column:
    """A relative path put on a directory, with '.' and '..' resolved; '..' above the root stays."""
    segments = F.filter(F.split(F.concat(directory, F.lit("/"), rel), "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    fold = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, s)),
    )
    return F.array_join(fold, "/")


def index_key(repo: Column, sha: Column) -> Column:
    return F.concat(repo, F.lit("@"), sha)


def key_parts(key: Column) -> Column:
    """owner, repo and sha of a key, split at its last '@'."""
    at = F.length(key) - F.instr(F.reverse(key), "@") + 1
    name = F.substring(key, F.lit(1), at - 1)
    return F.struct(F.split_part(name, F.lit("/"), F.lit(1)).alias("owner"), F.split_part(name, F.lit("/"), F.lit(2)).alias("repo"), F.substring(key, at + 1, F.length(key)).alias("sha"))


def is_repo_ref(repo: Column) -> Column:
    return repo.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})/[A-Za-z0-9._-]{1,100}\z")


def is_sha(sha: Column) -> Column:
    return sha.rlike(r"^[0-9a-f]{40}\z")


def repo_of_input(text: Column) -> Column:
    """owner/name from what users type: a URL, an ssh address, a deep link or the name itself; null if none."""
    s = F.regexp_replace(F.trim(text), r"(?i)^(?:git\+)?(?:https?://|ssh://)?(?:git@)?(?:www\.)?(?:github\.com[:/])", "")
    m = F.regexp_replace(F.regexp_extract(s, r"^([A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]{1,100})(?:[/?#].*)?\z", 1), r"(?i)\.git\z", "")
    return F.when(m != "", m)


# Phrases of a text that looks like instructions to a model.
SUSPICIOUS = (
    r"(?i)ignore (all |any )?(the )?(previous|prior|above) (instructions|prompts?)|disregard (the )?(system|previous)|reveal (the |your )?(system )?prompt"
    r"|system override|you are now|as an? (ai|assistant)[, ]"
)


def suspicious(text: Column) -> Column:
    """Text that looks like instructions to a model; a flag for information only."""
    return text.rlike(SUSPICIOUS)
