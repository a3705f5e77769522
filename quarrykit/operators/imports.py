"""Imports and exports of source files, and the files that imports resolve to.

Lines are matched by expressions inside the JVM; resolution is one equi-join of the candidate
paths with the files of the same build, the first candidate in a fixed order winning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit import config as C
from quarrykit.functions import paths as P
from quarrykit.functions import text as T
from quarrykit.session import checkpointed
from quarrykit.sources import jsonc

FROM = r"(?:^|[\s;}])(?:from|import)\s*[\"']([^\"'\n]+)[\"']"
CALL = r"(?<![A-Za-z0-9_$.])(?:require|import)\(\s*[\"']([^\"'\n]+)[\"']\s*\)"
NAMES = r"\{([^{}]*)\}\s*(?:from|=)"


def import_rows(ingested: DataFrame) -> DataFrame:
    """file_id, repo, sha, path, line, specifier, kind, names: one row per import of a JavaScript or TypeScript file.

    An import that spans lines is found on the line of its specifier; comments are not told from code.
    """
    f = ingested.dropDuplicates(["file_id"]).where(F.col("path").rlike(r"\.(?:[cm]?[jt]s|[jt]sx)$"))
    rows = f.select("file_id", "repo", "sha", "path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "text"))
    rows = rows.where(F.col("text").rlike("import|require|from"))
    static, call = F.regexp_extract_all("text", F.lit(FROM), F.lit(1)), F.regexp_extract_all("text", F.lit(CALL), F.lit(1))
    kinds = F.concat(
        F.transform(static, lambda s: F.struct(s.alias("specifier"), F.when(F.col("text").rlike(r"^\s*export\b"), "reexport").otherwise("import").alias("kind"))),
        F.transform(call, lambda s: F.struct(s.alias("specifier"), F.when(F.col("text").contains("require("), "require").otherwise("dynamic").alias("kind"))),
    )
    names = F.filter(F.transform(F.split(F.regexp_extract("text", NAMES, 1), ","), lambda n: F.trim(F.regexp_replace(n, r"\s+as\s+.*|:.*|^\s*type\s+", ""))), lambda n: n != "")
    out = rows.select("file_id", "repo", "sha", "path", (F.col("i") + 1).alias("line"), F.explode(kinds).alias("k"), names.alias("names"))
    return out.select("file_id", "repo", "sha", "path", "line", F.col("k.specifier").alias("specifier"), F.col("k.kind").alias("kind"), "names")


def export_rows(ingested: DataFrame) -> DataFrame:
    """file_id, repo, name, line of exported declarations, one name for each line."""
    f = ingested.dropDuplicates(["file_id"]).where(F.col("path").rlike(r"\.(?:[cm]?[jt]s|[jt]sx)$"))
    rows = f.select("file_id", "repo", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "text"))
    name = F.coalesce(
        F.nullif(F.regexp_extract("text", r"^export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r"^(?:module\.)?exports\.([A-Za-z_$][A-Za-z0-9_$]*)\s*=", 1), F.lit("")),
    )
    return rows.select("file_id", "repo", name.alias("name"), (F.col("i") + 1).alias("line")).where(F.col("name").isNotNull())


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[A-Za-z0-9]+)\z", 1)


def candidates(base: Column, declarations: bool = False) -> Column:
    """Paths a relative specifier may stand for, in order: as it is, with an extension, an index file, TypeScript for JavaScript."""
    out = [base]
    if declarations:
        out += [F.concat(base, F.lit(".d.ts")), F.concat(base, F.lit("/index.d.ts"))]
    out += [F.concat(base, F.lit(e)) for e in C.RESOLVE_EXTENSIONS]
    out += [F.concat(base, F.lit(f"/index{e}")) for e in C.RESOLVE_EXTENSIONS]
    stem = F.regexp_replace(base, r"\.[A-Za-z0-9]+\z", "")
    swap = F.array().cast("array<string>")
    for e, alts in C.JS_TO_TS.items():
        swap = F.when(extension(base) == e, F.array(*[F.concat(stem, F.lit(a)) for a in alts])).otherwise(swap)
    return F.concat(F.array(*out), swap)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """A folder and all folders above it, the root as the empty string."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def alias_candidates(specifier: Column, pattern: Column, target: Column) -> Column:
    """What a path alias makes of a specifier: exact, or with one '*'; null if it does not match."""
    star = F.instr(pattern, "*")
    prefix = F.substring(pattern, F.lit(1), F.greatest(star - 1, F.lit(0)))
    suffix = F.substring(pattern, star + 1, F.length(pattern))
    n = F.length(specifier) - F.length(prefix) - F.length(suffix)
    fits = (star > 0) & F.startswith(specifier, prefix) & F.endswith(specifier, suffix) & (n >= 0)
    return F.when((star == 0) & (pattern == specifier), target).when(fits, F.replace(target, F.lit("*"), F.substring(specifier, F.length(prefix) + 1, n)))


def indexed(files: DataFrame) -> DataFrame:
    """Files with ``excluded``: those whose path keeps them out of an index.  Nothing resolves to them."""
    return files.select("file_id", "repo", "sha", "path", P.skip_reason(F.col("path")).isNotNull().alias("excluded"))


def _tried(rows: DataFrame, keys: list[Column | str], bases: Column, declarations: bool = False) -> DataFrame:
    """keys, repo, sha, order, cand of an array of base paths, those that are null left out.

    A base is a row of its own before its candidates are made of it: a path is put together by a fold, which
    would else be run for each of them.
    """
    each = rows.select(*keys, F.posexplode(bases).alias("b", "base")).where("base IS NOT NULL")
    kept = [c for c in each.columns if c not in ("b", "base")]
    return each.select(*kept, "b", F.posexplode(candidates(F.col("base"), declarations)).alias("pos", "cand")).withColumn("order", F.struct("b", "pos")).drop("b", "pos")


def _first_hit(tries: DataFrame, keys: list[str], files: DataFrame, name: str) -> DataFrame:
    """tries: keys, repo, sha, order, cand -> keys and the file of the first candidate in order that exists."""
    target = files.where(~F.col("excluded")).select("repo", "sha", F.col("path").alias("cand"), F.col("file_id").alias("hit"))
    return tries.join(target, ["repo", "sha", "cand"]).groupBy(*keys).agg(F.min_by("hit", F.struct("order", "hit")).alias(name))


_ASKED = ["repo", "sha", "folder", "specifier"]


def alias_hits(asked: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """Asked specifiers that a path alias or base folder of a configuration above the folder turns into a file.

    asked: repo, sha, folder, specifier; configs: repo, sha, dir, config_id, base_dir, has_base, rules.  The folders
    above are keys of an equi-join; the deepest configuration counts first, in it the rules in order, then its base folder.
    """
    up = asked.select("*", F.explode(ancestors(F.col("folder"))).alias("dir"))
    j = up.join(configs, ["repo", "sha", "dir"])
    by_rule = F.transform("rules", lambda r, i: F.struct((i + 1).alias("place"), alias_candidates(F.col("specifier"), r["pattern"], r["target"]).alias("target")))
    own = F.when(F.col("has_base"), F.array(F.struct(F.lit(1_000_000).alias("place"), F.col("specifier").alias("target")))).otherwise(F.array().cast("array<struct<place:int,target:string>>"))
    t = j.select(*_ASKED, "dir", "config_id", "base_dir", F.explode(F.concat(by_rule, own)).alias("t")).where("t.target IS NOT NULL")
    rule = F.struct(-F.length("dir"), "config_id", "t.place").alias("rule")
    tries = _tried(t, [*_ASKED, rule], F.array(P.joined_path(F.col("base_dir"), F.col("t.target"))))
    return _first_hit(tries.withColumn("order", F.struct("rule", "order")), _ASKED, files, "alias_id")


def workspace_hits(asked: DataFrame, packs: DataFrame, files: DataFrame) -> DataFrame:
    """Asked specifiers of a package of the same commit: the sub-path below its folder or its src folder, else its entry.

    packs: repo, sha, package, dir (of the last manifest of that name), entry_file_id (of the first with one).
    """
    i = asked.withColumn("package", T.package_of(F.col("specifier"))).join(packs, ["repo", "sha", "package"])
    sub = F.substring("specifier", F.length("package") + 2, F.length("specifier"))
    tries = _tried(i.where(sub != ""), _ASKED, F.array(P.joined_path(F.col("dir"), sub), P.joined_path(F.concat(F.col("dir"), F.lit("/src")), sub)))
    j = i.join(_first_hit(tries, _ASKED, files, "sub_id"), _ASKED, "left")
    return j.select(*_ASKED, F.lit(True).alias("workspace"), F.when(sub == "", F.col("entry_file_id")).otherwise(F.col("sub_id")).alias("workspace_id"))


def resolved(imports: DataFrame, files: DataFrame, packs: DataFrame | None = None, configs: DataFrame | None = None, declarations: bool = True) -> DataFrame:
    """Imports with target_file_id (null if none) and resolution.

    files: file_id, repo, sha, path; packs: rows of ``packages`` with their entries (see ``entries``);
    configs: rows of ``compiler_configs``.  What a specifier means depends on its folder and commit alone, so
    each (commit, folder, specifier) is looked up once.  Resolution is relative:resolved, -:unresolved-asset,
    -:unresolved-excluded-file, -:unresolved-missing, bare:node-builtin, alias-or-baseurl:resolved,
    workspace-package:resolved, -:unresolved, alias:unresolved or bare:external-package.  An import of a file
    without repository or commit has no row; of two files with one path the smaller id counts.
    """
    spec, relative = F.col("specifier"), F.col("specifier").startswith(".")
    files = indexed(files)
    # imports are read off the texts once; all lookups below go over these narrow rows
    i = checkpointed(imports.withColumn("folder", directory(F.col("path"))))
    asked = i.select(*_ASKED).distinct()
    base = P.joined_path(F.col("folder"), spec)
    near = asked.where(relative).select(*_ASKED, F.explode(F.array(base)).alias("base"))
    found = _first_hit(near.select(*_ASKED, F.posexplode(candidates(F.col("base"), declarations)).alias("order", "cand")), _ASKED, files, "file_hit")
    shut = near.select(*_ASKED, F.explode(candidates(F.col("base"))).alias("cand")).join(files.where("excluded").select("repo", "sha", F.col("path").alias("cand")), ["repo", "sha", "cand"], "left_semi")
    j = asked.join(found, _ASKED, "left").join(shut.select(*_ASKED).distinct().withColumn("shut", F.lit(True)), _ASKED, "left")
    builtin = spec.startswith("node:") | spec.isin(C.BUILTINS)
    bare = asked.where(~relative & ~builtin)
    if packs is not None:
        by_dir = packs.where("entry_file_id IS NOT NULL").groupBy("repo", "sha", "dir").agg(F.min_by("entry_file_id", F.struct("file_id", "place")).alias("dir_hit"))
        j = j.join(near.join(by_dir.withColumnRenamed("dir", "base"), ["repo", "sha", "base"]).select(*_ASKED, "dir_hit"), _ASKED, "left")
        named = packs.where("package <> ''").groupBy("repo", "sha", "package").agg(
            F.max_by("dir", "file_id").alias("dir"), F.min_by("entry_file_id", F.when(F.col("entry_file_id").isNotNull(), F.struct("file_id", "place"))).alias("entry_file_id")
        )
        j = j.join(workspace_hits(bare, named, files), _ASKED, "left")
    else:
        j = j.withColumns({"dir_hit": F.lit(None).cast("bigint"), "workspace": F.lit(None).cast("boolean"), "workspace_id": F.lit(None).cast("bigint")})
    j = j.join(alias_hits(bare, configs, files), _ASKED, "left") if configs is not None else j.withColumn("alias_id", F.lit(None).cast("bigint"))
    asset = spec.rlike(r"(?i)\.(" + "|".join(C.ASSET_EXTENSIONS) + r")\z")
    target = F.when(relative, F.coalesce("file_hit", "dir_hit")).otherwise(F.coalesce("alias_id", "workspace_id"))
    kind = (
        F.when(relative & F.coalesce("file_hit", "dir_hit").isNotNull(), "relative:resolved")
        .when(relative & asset, "relative:unresolved-asset")
        .when(relative & F.col("shut"), "relative:unresolved-excluded-file")
        .when(relative, "relative:unresolved-missing")
        .when(builtin, "bare:node-builtin")
        .when(F.col("alias_id").isNotNull(), "alias-or-baseurl:resolved")
        .when(F.col("workspace") & F.col("workspace_id").isNotNull(), "workspace-package:resolved")
        .when(F.col("workspace"), "workspace-package:unresolved")
        .when(spec.startswith("@/") | spec.startswith("~/") | spec.startswith("#"), "alias:unresolved")
        .otherwise("bare:external-package")
    )
    r = j.select(*_ASKED, target.alias("target_file_id"), kind.alias("resolution"))
    return i.join(r, _ASKED).select("file_id", "repo", "sha", "path", "line", "specifier", "kind", "names", "target_file_id", "resolution")


def category_counts(resolved_: DataFrame, most: int = 8) -> DataFrame:
    """repo, resolution, imports and, for what is unresolved, the first ``most`` samples "file -> specifier"."""
    sample = F.concat("path", F.lit(" -> "), "specifier")
    n = resolved_.groupBy("repo", "resolution").agg(F.count("*").alias("imports"))
    # one row for each sample text before the window, so that a hot category is combined first
    open_ = resolved_.where(F.col("resolution").contains("unresolved")).groupBy("repo", "resolution", sample.alias("sample")).agg(F.min("file_id").alias("file_id"), F.min("line").alias("line"))
    w = Window.partitionBy("repo", "resolution").orderBy("file_id", "line", "sample")
    few = open_.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("repo", "resolution").agg(F.array_sort(F.collect_list(F.struct("r", "sample"))).alias("s"))
    return n.join(few, ["repo", "resolution"], "left").select("repo", "resolution", "imports", F.array_join(F.transform("s", lambda x: x["sample"]), "\n").alias("samples"))


def compiler_configs(ingested: DataFrame) -> DataFrame:
    """config_id, repo, sha, dir, base_dir, has_base and rules of every tsconfig or jsconfig with path rules or a base folder."""
    name = P.base_name(F.col("path"))
    f = ingested.where(name.startswith("tsconfig") & name.endswith(".json") | (name == "jsconfig.json")).dropDuplicates(["file_id"])
    j = f.select(F.col("file_id").alias("config_id"), "repo", "sha", directory(F.col("path")).alias("dir"), jsonc.path_rules(F.col("content")).alias("c"))
    return j.where("c.base_url IS NOT NULL OR size(c.rules) > 0").select(
        "config_id", "repo", "sha", "dir", P.joined_path(F.col("dir"), F.coalesce("c.base_url", F.lit("."))).alias("base_dir"), F.col("c.base_url").isNotNull().alias("has_base"), "c.rules"
    )


def packages(ingested: DataFrame) -> DataFrame:
    """file_id, repo, sha, dir, package, place, entry_kind and target: one row per target that a package.json declares.

    Targets in order of main, module, browser, bin and exports; a manifest without any means ./index.js; one that
    does not parse has no row; a package without a name has an empty one.
    """
    f = ingested.where(P.base_name(F.col("path")) == "package.json").dropDuplicates(["file_id"])
    j = f.select("file_id", "repo", "sha", directory(F.col("path")).alias("dir"), jsonc.manifest(F.col("content")).alias("j")).where("j.name IS NOT NULL")
    t = F.filter("j.targets", lambda x: ~x["target"].rlike(C.NO_ENTRY) & ~x["target"].startswith("/"))
    t = F.when(F.size(t) == 0, F.array(F.struct(F.lit("main").alias("kind"), F.lit("./index.js").alias("target")))).otherwise(t)
    dotted = F.when(F.col("t.target").startswith("."), F.col("t.target")).otherwise(F.concat(F.lit("./"), F.col("t.target")))
    return j.select("file_id", "repo", "sha", "dir", F.col("j.name").alias("package"), F.posexplode(t).alias("place", "t")).select(
        "file_id", "repo", "sha", "dir", "package", "place", F.col("t.kind").alias("entry_kind"), dotted.alias("target")
    )


def entries(pkgs: DataFrame, files: DataFrame) -> DataFrame:
    """Declared targets with the file they stand for: as declared, in a source folder for a build folder, or by name in a source folder."""
    rel = pkgs.select("file_id", "place", "repo", "sha", "dir", F.explode(F.array(P.joined_path(F.lit(""), F.col("target")))).alias("rel"))
    segments = F.split("rel", "/")
    tail, last = F.array_join(F.slice(segments, F.lit(2), F.size(segments)), "/"), F.element_at(segments, -1)
    below = lambda rest: P.joined_path(F.col("dir"), rest)
    swapped = [F.when(F.element_at(segments, 1).isin(C.BUILD_DIRS), below(F.concat(F.lit(f"{x}/"), tail))) for x in C.SOURCE_DIRS]
    bases = F.array(below(F.col("rel")), *swapped, *[below(F.concat(F.lit(f"{x}/"), last)) for x in C.SOURCE_DIRS])
    cand = _tried(rel, ["file_id", "place", "repo", "sha"], bases)
    return pkgs.join(_first_hit(cand, ["file_id", "place"], indexed(files), "entry_file_id"), ["file_id", "place"], "left")


def entry_stats(entries_: DataFrame) -> DataFrame:
    """repo, declared, resolved and the unresolved targets ("folder:target") of the manifests of a repository."""
    open_ = F.array_sort(F.collect_set(F.when(F.col("entry_file_id").isNull(), F.concat(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.lit(":"), "target"))))
    return entries_.groupBy("repo").agg(F.count("*").alias("declared"), F.count("entry_file_id").alias("resolved"), F.array_join(open_, "\n").alias("unresolved"))
