"""Strict parsing of model replies and validation of their citations against the evidence offered.

A citation that passes is one that exists and quotes its block; whether the block supports the
claim is not decided here.  The first rule that fails gives the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import text as T

CLAIMS, CLAIM_CHARS, CITATIONS, QUOTE, RAW_QUOTE, ID_CHARS = 8, 600, 6, 400, 4_000, 40
REPLY = "status STRING, claims ARRAY<STRUCT<text: STRING, evidence: ARRAY<STRUCT<citation: STRING, quote: STRING>>>>, missing STRING, unsupported ARRAY<STRING>"


def json_body(raw: Column) -> Column:
    """The JSON text of a reply: without blanks and a code fence, else from the first to the last brace; null if neither parses."""
    t = F.trim(F.regexp_replace(raw, r"^\s+|\s+\z", ""))
    fenced = F.regexp_extract(t, r"^```(?:json)?\s*([\s\S]*?)\s*```\z", 1)
    body = F.when(fenced != "", fenced).otherwise(t)
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    first = F.instr(body, "{")
    braces = F.when((first > 0) & (last > first), F.substring(body, first, last - first + 1))
    return F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(braces).isNotNull(), braces)


def _kind(v: Column, path: str) -> Column:
    """Type of a place in a variant, as SQL names it; null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def reply_reason(raw: Column, contract: int = 3) -> Column:
    """Why a reply is refused, or null if it has the required shape."""
    v = F.try_parse_json(json_body(raw))
    limit = QUOTE if contract == 2 else RAW_QUOTE
    status = F.when(_kind(v, "$.status") == "STRING", F.try_variant_get(v, "$.status", "string"))
    unsupported = F.try_variant_get(v, "$.unsupported", "array<variant>")
    no_field = F.try_variant_get(v, "$.unsupported", "variant").isNull()
    bad_unsupported = ~no_field & (
        unsupported.isNull()
        | (F.size(unsupported) > 5)
        | F.exists(unsupported, lambda x: (F.schema_of_variant(x) != "STRING") | (F.length(F.try_variant_get(x, "$", "string")) > 300))
    )
    claims = F.try_variant_get(v, "$.claims", "array<variant>")
    text = lambda c: F.try_variant_get(c, "$.text", "string")
    blank = lambda s: F.coalesce(F.length(T.squeezed(s)) == 0, F.lit(True))
    is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    evidence = lambda c: F.try_variant_get(c, "$.evidence", "array<variant>")

    def entry(e: Column) -> Column:
        cite, quote = F.try_variant_get(e, "$.citation", "string"), F.try_variant_get(e, "$.quote", "string")
        shape = (
            ~is_object(e) | (F.coalesce(_kind(e, "$.citation"), F.lit("")) != "STRING") | blank(cite) | (F.length(cite) > ID_CHARS)
            | (F.coalesce(_kind(e, "$.quote"), F.lit("")) != "STRING") | blank(quote)
        )
        return F.when(shape, "evidence entry malformed").when(F.length(quote) > limit, "quote too long")

    def claim(c: Column) -> Column:
        es = evidence(c)
        return (
            F.when(~is_object(c), "claim is not an object")
            .when((F.coalesce(_kind(c, "$.text"), F.lit("")) != "STRING") | blank(text(c)) | (F.length(text(c)) > CLAIM_CHARS), "claim text missing or too long")
            .when(es.isNull() | (F.size(es) > CITATIONS), "claim evidence must be a list")
            .otherwise(F.try_element_at(F.filter(F.transform(es, entry), lambda r: r.isNotNull()), F.lit(1)))
        )

    first_claim = F.try_element_at(F.filter(F.transform(claims, claim), lambda r: r.isNotNull()), F.lit(1))
    declined = F.when(~F.try_variant_get(v, "$.missing", "variant").isNull() & (F.coalesce(_kind(v, "$.missing"), F.lit("")) != "STRING"), "missing must be a string").when(
        bad_unsupported, "unsupported must be short strings"
    )
    return (
        F.when(v.isNull() | ~is_object(v), "not a JSON object")
        .when(status == "insufficient_evidence", declined)
        .when(status.isNull() | (status != "answered"), "status unknown")
        .when(claims.isNull() | (F.size(claims) == 0) | (F.size(claims) > CLAIMS), "claims must be a list of 1 to 8")
        .when(first_claim.isNotNull(), first_claim)
        .when(bad_unsupported, "unsupported must be short strings")
    )


def parsed(replies: DataFrame, contract: int = 3) -> DataFrame:
    """Replies (reply_id, raw) with reason and, where that is null, the typed reply."""
    r = replies.withColumn("reason", reply_reason(F.col("raw"), contract))
    return r.withColumn("reply", F.when(F.col("reason").isNull(), F.from_json(json_body(F.col("raw")), REPLY)))


def citation_rows(replies: DataFrame) -> DataFrame:
    """reply_id, claim_no, citation_no, citation, quote of accepted replies; a claim without evidence has one row of nulls."""
    c = replies.where("reply.status = 'answered'").select("reply_id", F.posexplode("reply.claims").alias("i", "c"))
    e = c.select("reply_id", (F.col("i") + 1).alias("claim_no"), F.posexplode_outer("c.evidence").alias("j", "e"))
    return e.select("reply_id", "claim_no", (F.col("j") + 1).alias("citation_no"), F.col("e.citation").alias("citation"), F.col("e.quote").alias("quote"))


def check_locators(locators: DataFrame, registry: DataFrame) -> DataFrame:
    """Citations with the first of eight reasons they fail for, or null.

    locators: reply_id, evidence_id and optional owner, repo, sha, path, start_line, end_line;
    registry: reply_id, evidence_id, owner, repo, sha, path, start_line, end_line, file_lines
    and the expected owner, repo and sha as want_owner, want_repo, want_sha.  An id given twice counts
    as given last (largest ``pos``).
    """
    last = registry.groupBy("reply_id", "evidence_id").agg(F.max_by(F.struct(*[c for c in registry.columns if c not in ("reply_id", "evidence_id")]), "pos").alias("item"))
    j = locators.join(last, ["reply_id", "evidence_id"], "left")
    i = lambda c: F.col(f"item.{c}")
    differs = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(i(f"want_{c}"))
    a, b = F.coalesce("start_line", "end_line"), F.coalesce("end_line", "start_line")
    has = F.col("start_line").isNotNull() | F.col("end_line").isNotNull()
    reason = (
        F.when(F.col("item").isNull(), "unknown-evidence-id")
        .when(differs("owner") | differs("repo") | (i("owner") != i("want_owner")) | (i("repo") != i("want_repo")), "wrong-repository")
        .when(differs("sha") | (i("sha") != i("want_sha")), "wrong-sha")
        .when(F.col("path").isNotNull() & (F.col("path") != i("path")), "wrong-path")
        .when(has & ((a < 1) | (b < 1)), "invalid-line-number")
        .when(has & (a > b), "reversed-range")
        .when(has & (b > i("file_lines")), "range-beyond-file")
        .when(has & ((a < i("start_line")) | (b > i("end_line"))), "outside-evidence-range")
    )
    return j.withColumn("reason", reason).drop("item")


def verdicts(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status of every claim: cited, uncited, invalid-citation or quote-mismatch; evidence: reply_id, evidence_id, text, suspect."""
    rows = citation_rows(replies).join(
        evidence.select("reply_id", F.col("evidence_id").alias("citation"), F.col("text").alias("block"), "suspect"), ["reply_id", "citation"], "left"
    )
    valid = F.col("block").isNotNull()
    ok = valid & T.quote_is_verbatim(F.col("quote"), F.col("block"))
    g = rows.groupBy("reply_id", "claim_no").agg(
        F.count("citation").alias("citations"), F.count_if(F.col("citation").isNotNull() & ~valid).alias("invalid"), F.count_if(valid & ~ok).alias("misquoted"),
        (F.coalesce(F.bool_and(F.when(valid, F.col("suspect"))), F.lit(False)) & (F.count_if(valid) > 0)).alias("suspect_only"),
    )
    status = F.when(F.col("citations") == 0, "uncited").when(F.col("invalid") > 0, "invalid-citation").when(F.col("misquoted") > 0, "quote-mismatch").otherwise("cited")
    return g.withColumn("status", status)


def answer_status(claims: DataFrame) -> DataFrame:
    """An answer with any claim that is not cited is rejected as a whole."""
    return claims.groupBy("reply_id").agg(
        F.count("*").alias("claims"), F.when(F.bool_or(F.col("status") != "cited"), "rejected").otherwise("answered").alias("answer_status"),
        F.array_sort(F.collect_set(F.when(F.col("status") != "cited", F.col("status")))).alias("reasons"), F.bool_or("suspect_only").alias("warned"),
    )


def extractive_claim(text: Column, least: int = 12) -> Column:
    """The first quotable line of a block: long enough and no comment."""
    return F.try_element_at(
        F.filter(F.transform(T.lines(text), lambda x: F.trim(x)), lambda x: (F.length(x) >= least) & ~x.rlike(r"^(//|/?\*|#)")), F.lit(1)
    )
