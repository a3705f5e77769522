"""Evidence: late reading of source, verification by fingerprint, admission under a budget, and
further blocks (importers, definitions) that are not shown yet.

Groups are bounded by the candidates of one question, so the ordered folds run as higher-order
functions inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import paths as P
from quarrykit.functions import text as T
from quarrykit.session import buckets_for, stored

MOST_SPOTS, MOST_SCANS = 600_000, 4  # ranges (of some 110 bytes) that one scan of the sources is given, and scans before contents are moved instead


def _read(j: DataFrame) -> DataFrame:
    """The text of a range of the content beside it, the reason why it does not stand and whether it is suspicious."""
    n = F.size(T.lines(F.col("content")))
    text = T.line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))
    bad = (F.col("start_line") < 1) | (F.col("end_line") > n) | (F.col("start_line") > F.col("end_line")) | F.col("end_line").isNull()
    j = j.withColumn("text", F.when(~bad, text)).withColumn(
        "reason",
        F.when(F.col("content").isNull(), "source-unavailable").when(bad, "range-outside-file").when(T.fingerprint(F.col("text")) != F.col("chunk_hash"), "source-mismatch"),
    )
    return j.withColumn("suspect", F.coalesce(P.suspicious(F.col("text")), F.lit(False))).drop("content", "there")


def verified(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with text and reason: null if verified, else source-unavailable, range-outside-file or source-mismatch.

    candidates: file_id, start_line, end_line, chunk_hash and any others; sources: file_id, content.
    """
    src = sources.dropDuplicates(["file_id"]).select("file_id", "content", F.lit(True).alias("there"))
    j = candidates.join(src, "file_id", "left")
    return _read(j)


def verdicts(spots: DataFrame, sources: DataFrame) -> DataFrame:
    """chunk_id, reason and suspect of every spot as ``verified`` has them, without text; one row for each chunk.

    Spots go to the scan of the sources, ``MOST_SPOTS`` at a time, so no content moves; if that took more than ``MOST_SCANS``
    scans, the contents are shuffled.
    """
    spots = spots.select("chunk_id", "file_id", "start_line", "end_line", "chunk_hash").dropDuplicates(["chunk_id"])
    scans = buckets_for(spots.count(), MOST_SPOTS)
    if scans > MOST_SCANS:
        return verified(spots, sources).select("chunk_id", "reason", "suspect")
    src = sources.select("file_id", "content", F.lit(True).alias("there"))
    read = None
    for k in range(scans):
        part = spots.where(F.pmod(F.xxhash64("chunk_id"), F.lit(scans)) == k)
        one = stored(_read(src.join(F.broadcast(part), "file_id")).select("chunk_id", "reason", "suspect").dropDuplicates(["chunk_id"]))
        read = one if read is None else read.unionByName(one)
    there = F.col("suspect").isNotNull()
    return spots.select("chunk_id").join(read, "chunk_id", "left").select(
        "chunk_id", F.when(there, F.col("reason")).otherwise("source-unavailable").alias("reason"), F.coalesce("suspect", F.lit(False)).alias("suspect")
    )


def admitted(sizes: Column, most: int, budget: int) -> Column:
    """Which of an ordered array of sizes are admitted: at most ``most``, while they fit the budget.

    The first admitted one is exempt from the budget; one that does not fit is passed over and a
    later smaller one may still enter.
    """
    state = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("total"), F.array().cast("array<boolean>").alias("out")),
        lambda a, s: F.when(
            (a["n"] < most) & ((a["n"] == 0) | (a["total"] + s <= budget)),
            F.struct((a["n"] + 1).alias("n"), (a["total"] + s).cast("bigint").alias("total"), F.array_append(a["out"], F.lit(True)).alias("out")),
        ).otherwise(F.struct(a["n"].alias("n"), a["total"].alias("total"), F.array_append(a["out"], F.lit(False)).alias("out"))),
    )
    return state["out"]


def admit(items: DataFrame, group: str, order: list[str], size: str, most: int, budget: int) -> DataFrame:
    """Items of each group that are admitted in order, numbered E1, E2, ..."""
    others = [c for c in items.columns if c != group]
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], *[F.col(c) for c in others])
    g = items.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    g = g.withColumn("ok", admitted(F.transform("rows", lambda r: r[size]), most, budget))
    kept = F.filter(F.zip_with("rows", "ok", lambda r, k: F.struct(r.alias("r"), k.alias("ok"))), lambda x: x["ok"])
    return g.select(group, F.posexplode(kept).alias("n", "x")).select(group, F.concat(F.lit("E"), (F.col("n") + 1).cast("string")).alias("evidence_id"), *[F.col(f"x.r.{c}").alias(c) for c in others])


def not_shown(candidates: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose lines overlap nothing shown: a left anti join on the keys with an interval condition."""
    c, s = candidates.alias("c"), shown.alias("s")
    on = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    cond = cond & (F.col("c.start_line") <= F.col("s.end_line")) & (F.col("c.end_line") >= F.col("s.start_line"))
    return c.join(s, cond, "left_anti")


# Words before "(" that are no call.
NOT_A_CALL = (
    "if for while switch catch return typeof function await async new throw else do in of case delete void yield super import export default class constructor require"
).split()


def calls(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, pos: names followed by an opening parenthesis in a block of text."""
    found = F.regexp_extract_all("text", F.lit(r"(#?[A-Za-z_$][A-Za-z0-9_$]*)\s*\("), F.lit(1))
    return blocks.select(*keys, F.posexplode(found).alias("pos", "name")).where(~F.col("name").isin(NOT_A_CALL))


def called_definitions(called: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The one symbol a called name means, seen from a file: defined in it, in a file it imports, or once in the repository.

    called: repo, file_id, name (distinct); symbols: repo, symbol_id, file_id, name, of kinds that can
    be called, in source files; several candidates of the first kind that has any give none.
    """
    near = edges.select("file_id", "target_file_id").distinct().withColumn("imported", F.lit(True))
    c = called.select("repo", F.col("file_id").alias("from_file"), F.regexp_replace("name", "^#", "").alias("name")).distinct()
    j = c.join(symbols.select("repo", "symbol_id", F.col("file_id").alias("in_file"), "name"), ["repo", "name"])
    j = j.join(near.select(F.col("file_id").alias("from_file"), F.col("target_file_id").alias("in_file"), "imported"), ["from_file", "in_file"], "left")
    tier = F.when(F.col("in_file") == F.col("from_file"), 0).when(F.col("imported"), 1).otherwise(2)
    g = j.withColumn("tier", tier).groupBy("repo", "from_file", "name").agg(
        *[F.count_if(F.col("tier") == t).alias(f"n{t}") for t in range(3)], *[F.min(F.when(F.col("tier") == t, F.col("symbol_id"))).alias(f"s{t}") for t in range(3)]
    )
    one = lambda t: F.when(F.col(f"n{t}") == 1, F.col(f"s{t}"))
    pick = F.when(F.col("n0") > 0, one(0)).when(F.col("n1") > 0, one(1)).otherwise(one(2))
    return g.select("repo", "from_file", "name", pick.alias("symbol_id")).where(F.col("symbol_id").isNotNull())


def best_overlap(definitions: DataFrame, chunks: DataFrame, head: int = 40) -> DataFrame:
    """The chunk that holds most of the first lines of a definition; ties go to the smaller chunk id."""
    d, c = definitions.alias("d"), chunks.alias("c")
    end = F.least(F.col("d.end_line"), F.col("d.start_line") + head - 1)
    j = d.join(c, (F.col("d.file_id") == F.col("c.file_id")) & (F.col("c.start_line") <= end) & (F.col("c.end_line") >= F.col("d.start_line")))
    size = F.least(F.col("c.end_line"), end) - F.greatest(F.col("c.start_line"), F.col("d.start_line")) + 1
    return j.groupBy("d.symbol_id").agg(F.min_by("c.chunk_id", F.struct(-size, "c.chunk_id")).alias("chunk_id"), F.max(size).alias("overlap"))


def enclosing_symbol(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The smallest symbol that holds a line: file_id, line, symbol_id."""
    p, s = lines.alias("p"), symbols.alias("s")
    j = p.join(s, (F.col("p.file_id") == F.col("s.file_id")) & F.col("p.line").between(F.col("s.start_line"), F.col("s.end_line")))
    return j.groupBy("p.file_id", "p.line").agg(F.min_by("s.symbol_id", F.struct(F.col("s.end_line") - F.col("s.start_line"), "s.symbol_id")).alias("symbol_id"))


def imported_name(question: Column) -> Column:
    """What a question about importers asks for, or null: four ways to put it."""
    q = F.regexp_replace(F.trim(question), r"[?.!\s]+\z", "")
    # The forms such a question takes.
    forms = [
        r"(?i)(?<![A-Za-z0-9_])(?:which|what)\s+(?:[A-Za-z0-9_]+\s+){0,2}?(?:modules?|files?|packages?|components?)\s+(?:import|imports|importing|require|requires)\s+(.+)\z",
        r"(?i)(?<![A-Za-z0-9_])who\s+(?:imports|requires)\s+(.+)\z",
        r"(?i)(?<![A-Za-z0-9_])where\s+is\s+(.+?)\s+(?:imported|required)(?![A-Za-z0-9_])",
        r"(?i)(?<![A-Za-z0-9_])(?:list|show|find)\s+(?:all\s+)?(?:the\s+)?(?:modules?|files?)\s+(?:that\s+)?(?:import|imports|importing|require|requires)\s+(.+)\z",
    ]
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(q, f, 1)), F.lit("")) for f in forms])


# Words of a phrase that name nothing.
FILLER = "the a an module modules file files helper package function class component hook type".split()


def name_words(phrase: Column) -> Column:
    return F.filter(F.split(phrase, "[^A-Za-z0-9_$]+"), lambda w: (w != "") & ~F.lower(w).isin(FILLER))


def word_terms(words: Column) -> Column:
    parts = F.flatten(F.transform(words, lambda w: F.transform(T.split_identifier(w), lambda t: T.stem(t))))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2))


def asked_imports(questions: DataFrame) -> DataFrame:
    """repo, question_id, name, terms, last, module, hint: what a question about importers asks for.

    name: one imported name, or null; module: whether a file is meant; hint: terms of the Y of "X from Y", or null.
    """
    q = questions.select("repo", "question_id", imported_name(F.col("question")).alias("phrase")).where("phrase IS NOT NULL")
    has_from = F.col("phrase").rlike(r"(?i)^\S+\s+from\s+.+\z")
    single = name_words(F.col("phrase"))
    name = F.when(has_from, F.regexp_extract("phrase", r"(?i)^(\S+)\s+from\s+", 1)).when(F.size(single) == 1, F.element_at(single, 1))
    module = ~has_from & F.col("phrase").rlike(r"(?i)(?<![A-Za-z0-9_])(?:module|file|helper|package)s?\z")
    return q.select(
        "repo", "question_id", name.alias("name"), word_terms(single).alias("words"), F.lower(F.try_element_at(single, F.lit(-1))).alias("last"),
        (module | (name.isNull() & (F.size(single) > 0))).alias("module"),
        F.when(has_from, word_terms(name_words(F.regexp_extract("phrase", r"(?i)^\S+\s+from\s+(.+)\z", 1)))).alias("hint"),
    )


def importers(questions: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """question_id, target, file_id, path, file_class, line, rank: files that import what a question asks about, source files first.

    imports: as of ``imports.resolved``; files: repo, file_id, path, file_class.  A phrase that means one source file
    asks for the importers of that file, one name for those of that name, "X from Y" for imports of X from
    something called Y; nothing is guessed for any other.
    """
    from quarrykit.operators.questions import file_named

    asked = asked_imports(questions)
    source = files.where("file_class = 'source'").select("repo", "file_id", "path")
    meant = file_named(asked.where("module").select("repo", "question_id", "words", "last"), source)
    i = imports.select("repo", "file_id", "line", "specifier", "names", "target_file_id")
    by_file = meant.select("question_id", F.col("file_id").alias("target_file_id")).join(i.drop("repo"), "target_file_id").join(
        files.select(F.col("file_id").alias("target_file_id"), F.col("path").alias("target")), "target_file_id"
    )
    by_file = by_file.select("question_id", "target", "file_id", "line")
    rest = asked.where(F.col("name").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z")).join(by_file.select("question_id").distinct(), "question_id", "left_anti")
    named = rest.join(i.select("*", F.explode(F.array_distinct("names")).alias("name")), ["repo", "name"])
    named = named.join(files.select(F.col("file_id").alias("target_file_id"), T.path_terms(F.col("path")).alias("near")), "target_file_id", "left")
    fits = F.when(F.col("target_file_id").isNotNull(), F.forall("hint", lambda t: F.array_contains("near", t))).otherwise(F.forall("hint", lambda t: F.contains(F.lower("specifier"), t)))
    by_name = named.where(F.col("hint").isNull() | ((F.size("hint") > 0) & fits)).select("question_id", F.col("name").alias("target"), "file_id", "line")
    hit = by_file.unionByName(by_name).groupBy("question_id", "target", "file_id").agg(F.min("line").alias("line"))
    hit = hit.join(files.select("file_id", "path", "file_class"), "file_id")
    w = Window.partitionBy("question_id").orderBy(F.when(F.col("file_class") == "source", 0).otherwise(1), "path", "file_id")
    return hit.withColumn("rank", F.row_number().over(w))


def importer_blocks(found: DataFrame, chunks: DataFrame, shown: DataFrame, most: int = 4) -> DataFrame:
    """question_id, chunk_id, place: chunks with the import lines of the source files among importers, of all if none is source.

    found: as of ``importers``; shown: question_id, file_id, start_line, end_line.  Lines on show are left out, a chunk
    comes once, at most ``most`` of a question.
    """
    any_source = F.max(F.col("file_class") == "source").over(Window.partitionBy("question_id"))
    f = found.withColumn("any", any_source).where(~F.col("any") | (F.col("file_class") == "source")).alias("f")
    s = shown.alias("s")
    on = (F.col("f.question_id") == F.col("s.question_id")) & (F.col("f.file_id") == F.col("s.file_id")) & F.col("f.line").between(F.col("s.start_line"), F.col("s.end_line"))
    left, c = f.join(s, on, "left_anti").alias("f"), chunks.alias("c")
    hit = left.join(c, (F.col("f.file_id") == F.col("c.file_id")) & F.col("f.line").between(F.col("c.start_line"), F.col("c.end_line")))
    one = hit.groupBy("f.question_id", "f.file_id", "f.rank").agg(F.min_by("c.chunk_id", F.struct(-F.col("c.start_line"), "c.chunk_id")).alias("chunk_id"))
    one = one.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id"))).where(F.col("place") <= most).drop("rank")


def definition_candidates(called: DataFrame, found: DataFrame, symbols: DataFrame, terms: DataFrame, best: DataFrame, shown: DataFrame, most: int) -> DataFrame:
    """question_id, chunk_id, symbol_id, place: definitions of what the evidence of a question calls, the best ``most``.

    called: question_id, repo, file_id, name, pos (each call in the blocks shown, in order); found: from_file, name, symbol_id (see
    ``called_definitions``); terms: question_id, term; best: symbol_id, chunk_id (see ``best_overlap``); shown: question_id,
    chunk_id.  Names that share more words with the question come first, then those called more often, then the
    earlier; a chunk on show or taken by a better name is left out.
    """
    c = called.withColumn("name", F.regexp_replace("name", "^#", "")).join(found.withColumnRenamed("from_file", "file_id"), ["file_id", "name"])
    one = c.groupBy("question_id", "symbol_id").agg(F.first("name").alias("name"), F.count("*").alias("calls"), F.min("pos").alias("pos"))
    parts = one.select("question_id", "symbol_id", F.explode(word_terms(F.array("name"))).alias("term")).join(terms, ["question_id", "term"], "left_semi")
    shared = parts.groupBy("question_id", "symbol_id").agg(F.count("*").alias("shared"))
    j = one.join(shared, ["question_id", "symbol_id"], "left").join(best.select("symbol_id", "chunk_id"), "symbol_id").join(symbols.select("symbol_id"), "symbol_id", "left_semi")
    j = j.join(shown.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    order = [F.desc(F.coalesce("shared", F.lit(0))), F.desc("calls"), "pos", "symbol_id"]
    j = j.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy(*order))).where("r = 1")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("place") <= most).select("question_id", "chunk_id", "symbol_id", "place")
