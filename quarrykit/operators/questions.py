"""Questions about entry points and files, rates of coverage, and joins that compare runs and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import text as T

# Kinds of entry in their order, how a manifest declares one, words that say nothing.
KINDS = ["main", "module", "exports", "browser", "bin", "types"]
DECLARES = r"^\s*\"(?:main|module|exports|bin|browser|types)\"\s*:"
WEAK = "the and for how does where what when which who why are was its from with that this into each all any can get set use run has have not".split()


def asks_for_entry(question: Column) -> Column:
    # Phrases that ask for an entry point.
    return question.rlike(
        r"(?i)(?<![A-Za-z0-9_])(?:entry[\s-]?(?:points?|files?|modules?)|package\s+(?:exports?|entr(?:y|ies))|main\s+(?:file|module|entry)|exports?\s+(?:field|map))(?![A-Za-z0-9_])"
    )


def mentions(question: Column, package: Column) -> Column:
    """Whether a question names a package, in full or by its last part, as a word of its own."""
    q = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    bare = F.element_at(F.split(F.lower(package), "/"), -1)
    inside = lambda name: F.exists(
        F.split(F.regexp_replace(q, r"[^a-z0-9_@/.-]+", " "), " "), lambda w: F.regexp_replace(w, r"[.]+\z", "") == name
    )
    return inside(F.lower(package)) | inside(bare)


def chosen_package(questions: DataFrame, packages: DataFrame) -> DataFrame:
    """question_id, package: the package a question about entry points means: the only one, the one it names, or the repository's own.

    packages: repo, package (with declared entries); questions: repo, question_id, question.
    """
    p = packages.select("repo", "package").distinct()
    j = questions.where(asks_for_entry(F.col("question"))).join(p, "repo").withColumn("named", mentions(F.col("question"), F.col("package")))
    own = F.col("package") == F.element_at(F.split("repo", "/"), -1)
    g = j.groupBy("question_id").agg(
        F.count("*").alias("n"), F.min("package").alias("one"), F.count_if("named").alias("names"), F.min(F.when(F.col("named"), F.col("package"))).alias("named"), F.min(F.when(own, F.col("package"))).alias("own")
    )
    pick = F.when(F.col("n") == 1, F.col("one")).when(F.col("names") == 1, F.col("named")).when(F.col("names") == 0, F.col("own"))
    return g.select("question_id", pick.alias("package")).where("package IS NOT NULL")


def ordered_entries(entries: DataFrame) -> DataFrame:
    """Distinct (package, kind, path) with their place: kinds in order of weight, then paths."""
    d = entries.select("repo", "package", "entry_kind", "path").distinct()
    o = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("entry_kind"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("repo", "package").orderBy(o, "path")))


def nearest_manifest(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path -> the package.json at or nearest above it: every ancestor folder becomes a key of one equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n), F.array(F.lit("package.json"))))
    keys = paths.select("repo", "sha", "path", F.posexplode(above).alias("depth", "manifest"))
    have = files.select("repo", "sha", F.col("path").alias("manifest"), F.col("file_id").alias("manifest_id")).distinct()
    return keys.join(have, ["repo", "sha", "manifest"]).groupBy("repo", "sha", "path").agg(F.max_by("manifest", "depth").alias("manifest"), F.max_by("manifest_id", "depth").alias("manifest_id"))


def declaring_lines(manifests: DataFrame) -> DataFrame:
    """file_id, line: first line of a manifest (file_id, content) that declares an entry."""
    rows = manifests.select("file_id", F.posexplode(F.split("content", "\n")).alias("i", "text")).where(F.col("text").rlike(DECLARES))
    return rows.groupBy("file_id").agg((F.min("i") + 1).alias("line"))


def file_named(questions: DataFrame, files: DataFrame) -> DataFrame:
    """question_id, file_id: the only source file whose path holds all words a question is about.

    questions: repo, question_id, words (array) and, if it is not the last of them, last; files: repo, file_id, path,
    of class source.  Of several, one that is named for the last word is taken if it is the only such.
    """
    last = F.col("last") if "last" in questions.columns else F.element_at("words", -1)
    w = questions.where(F.size("words") > 0).select("repo", "question_id", last.alias("last"), F.size(F.array_distinct("words")).alias("n"), F.explode(F.array_distinct("words")).alias("term"))
    t = files.select("repo", "file_id", "path", F.explode(T.path_terms(F.col("path"))).alias("term"))
    hit = w.join(t, ["repo", "term"]).groupBy("question_id", "file_id", "path", "last", "n").agg(F.count("*").alias("found")).where(F.col("found") == F.col("n"))
    base = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+\z", ""))
    folder = F.lower(F.try_element_at(F.split("path", "/"), F.lit(-2)))
    hit = hit.withColumn("exact", (base == F.col("last")) | ((base == "index") & (folder == F.col("last"))))
    g = hit.groupBy("question_id").agg(F.count("*").alias("n"), F.min("file_id").alias("one"), F.count_if("exact").alias("exact"), F.min(F.when(F.col("exact"), F.col("file_id"))).alias("named"))
    return g.select("question_id", F.when(F.col("n") == 1, F.col("one")).when(F.col("exact") == 1, F.col("named")).alias("file_id")).where("file_id IS NOT NULL")


def asked_words(question: Column) -> Column:
    """Distinct sub-words of a question of three letters or more that say something."""
    parts = F.flatten(F.transform(F.filter(F.split(question, "[^A-Za-z0-9_$#]+"), lambda w: w != ""), lambda w: F.transform(T.split_identifier(w), lambda t: T.stem(t))))
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(WEAK)))


def changed_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions whose first hit differs between two runs (question_id, negative, first_hit); positives only, null is a miss."""
    j = a.where("not negative").select("question_id", F.col("first_hit").alias("before")).join(b.where("not negative").select("question_id", F.col("first_hit").alias("after")), "question_id")
    return j.where(~F.col("before").eqNullSafe(F.col("after")))


def reviewed_labels(items: DataFrame, human: DataFrame, older: DataFrame) -> DataFrame:
    """Items (id, label) with the label that counts: a finished human review, else an older review, else the draft."""
    h = human.where("reviewed AND final_label IS NOT NULL").select("id", F.col("final_label").alias("human_label"))
    o = older.select("id", F.col("label").alias("older_label"))
    j = items.join(h, "id", "left").join(o, "id", "left")
    source = F.when(F.col("human_label").isNotNull(), "human").when(F.col("older_label").isNotNull(), "older").otherwise("draft")
    return j.select("id", F.coalesce("human_label", "older_label", "label").alias("label"), F.col("label").alias("draft_label"), source.alias("label_source"))


def review_problems(reviews: DataFrame, items: DataFrame, labels: list[str]) -> DataFrame:
    """id, problem: duplicates, unknown and missing ids, and labels that do not fit."""
    dup = reviews.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    unknown = reviews.select("id").distinct().join(items.select("id").distinct(), "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    missing = items.select("id").distinct().join(reviews.select("id").distinct(), "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    ok = F.when(F.col("reviewed"), F.col("final_label").isin(labels)).otherwise(F.col("final_label").isNull())
    bad = reviews.where(~F.coalesce(ok, F.lit(False))).select("id", F.lit("bad-label").alias("problem")).distinct()
    return dup.unionByName(unknown).unionByName(missing).unionByName(bad)


def failures(scores: DataFrame, results: DataFrame, most: int = 4) -> DataFrame:
    """Positive questions without a hit in the first five, with the first results."""
    top = results.where(F.col("rank") <= most).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "start_line", "end_line"))).alias("first_results"))
    return scores.where("not negative and not hit5").select("question_id", "repo", "category", "first_hit").join(top, "question_id", "left")


def needs_met(needs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cases by pattern: needs met by any evidence that overlaps them, and cases with all needs met.

    needs: case_id, pattern, need_id, path, first_line, last_line; evidence: case_id, path, start_line, end_line.
    """
    n, e = needs.alias("n"), evidence.alias("e")
    on = (F.col("n.case_id") == F.col("e.case_id")) & (F.col("n.path") == F.col("e.path")) & (F.col("e.start_line") <= F.col("n.last_line")) & (F.col("e.end_line") >= F.col("n.first_line"))
    met = n.join(e, on, "left_semi").select("case_id", "need_id").distinct().withColumn("met", F.lit(True))
    j = needs.join(met, ["case_id", "need_id"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    case = j.groupBy("pattern", "case_id").agg(F.count("*").alias("needs"), F.count_if("met").alias("met"), F.bool_and("met").alias("full"))
    return case.groupBy("pattern").agg(F.count("*").alias("cases"), F.sum("needs").alias("needs"), F.sum("met").alias("met"), F.count_if("full").alias("full"))


def policy_grid(features: DataFrame, pairs: list[tuple[float, float]]) -> DataFrame:
    """What every (low, high) pair of coverage thresholds would do with the questions.  The pairs are a constant."""
    from quarrykit.operators.retrieval import decision

    g = features.sparkSession.createDataFrame(pairs, "low DOUBLE, high DOUBLE")
    j = features.crossJoin(F.broadcast(g)).withColumn("decision", decision(F.col("idf_coverage"), F.col("evidence"), F.col("low"), F.col("high")))
    return j.groupBy("low", "high", "decision").agg(F.count("*").alias("questions"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """One row of counts over answers: question_id, negative, status, cites_expected, mentions_met, citations, valid_citations, claims, evidence_chars."""
    neg, ok = F.col("negative"), F.col("status") == "answered"
    refused = F.col("status").isin("insufficient_evidence", "no_evidence")
    return answers.agg(
        F.count("*").alias("questions"), F.count_if(~neg).alias("positives"), F.count_if(neg).alias("negatives"), F.sum("citations").alias("citations"), F.sum("valid_citations").alias("valid"),
        F.count_if(~neg & ok).alias("positives_answered"), F.count_if(~neg & refused).alias("positives_refused"), F.count_if(neg & refused).alias("negatives_refused"), F.count_if(neg & ok).alias("negatives_answered"),
        F.count_if(~neg & ok & F.col("cites_expected") & F.col("mentions_met")).alias("correct"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.median("evidence_chars").alias("median_chars"), F.max("evidence_chars").alias("most_chars"),
    )


def entry_blocks(manifest_lines: DataFrame, entry_lines: DataFrame, chunks: DataFrame, shown: DataFrame, most: int = 2) -> DataFrame:
    """question_id, chunk_id, place: the chunks with the declaring line and the entry's first export, not shown yet, at most ``most``.

    manifest_lines, entry_lines and shown: question_id, file_id with line, or start_line and end_line.
    """
    want = manifest_lines.select("question_id", "file_id", "line", F.lit(0).alias("o")).unionByName(entry_lines.select("question_id", "file_id", "line", F.lit(1).alias("o")))
    w, s = want.alias("w"), shown.alias("s")
    on = (F.col("w.question_id") == F.col("s.question_id")) & (F.col("w.file_id") == F.col("s.file_id")) & F.col("w.line").between(F.col("s.start_line"), F.col("s.end_line"))
    left, c = w.join(s, on, "left_anti").alias("w"), chunks.alias("c")
    hit = left.join(c, (F.col("w.file_id") == F.col("c.file_id")) & F.col("w.line").between(F.col("c.start_line"), F.col("c.end_line")))
    one = hit.groupBy("w.question_id", "c.chunk_id").agg(F.min("w.o").alias("o"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("o", "chunk_id"))
    return one.withColumn("place", place).where(F.col("place") <= most).drop("o")


def kept_verdicts(fresh: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows with the verdict recorded for their key; a recorded verdict whose key is gone is an error, raised when it is run."""
    orphan = recorded.join(fresh.select(*keys), keys, "left_anti").select(*keys, F.raise_error(F.lit("a recorded verdict would be lost")).cast("string").alias("verdict"))
    out = fresh.join(recorded.select(*keys, "verdict"), keys, "left")
    return out.unionByName(orphan, allowMissingColumns=True)


def validated_again(records: DataFrame, replies: DataFrame, reason: str = "quote too long") -> DataFrame:
    """Records (reply_id, reason, ...) of which only those refused for ``reason`` take the outcome of a new validation; all others stay."""
    again = records.where(F.col("reason") == reason).drop("reason").join(replies.select("reply_id", "reason"), "reply_id")
    return records.where(~F.coalesce(F.col("reason") == reason, F.lit(False))).unionByName(again.select(*records.columns))


def fixture_passes(results: DataFrame, expected: DataFrame) -> DataFrame:
    """question_id, passed: a positive passes if its path comes first, a negative if no hostile path does.

    results: question_id, rank, path; expected: question_id, path (null for a negative), hostile (array of paths).
    """
    first = results.where("rank = 1").select("question_id", F.col("path").alias("first_path"))
    j = expected.join(first, "question_id", "left")
    ok = F.when(F.col("path").isNotNull(), F.col("first_path").eqNullSafe(F.col("path"))).otherwise(~F.coalesce(F.array_contains("hostile", F.col("first_path")), F.lit(False)))
    return j.select("question_id", ok.alias("passed"))
