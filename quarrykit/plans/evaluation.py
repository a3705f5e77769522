"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.operators import evaluation as V
from quarrykit.operators import questions as QN
from quarrykit.plans import common as C
from quarrykit.plans import dialect as D
from quarrykit.plans.fused import FEATURES
from quarrykit.plans.retrieval import LEXICAL, features, lexical_top
from quarrykit.session import checkpointed, stored, table

PAIRS = [(low, high) for low in (0.2, 0.3, 0.4) for high in (0.5, 0.65)]
LABELS = ["SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED"]


def _scores(s, d):
    return checkpointed(V.question_scores(C.questions(s, d), stored(lexical_top(s, d))))


def _aggregate(s, d):
    return V.aggregate(_scores(s, d))


def _rows(s, d):
    """Features of every question as the fused search gives them, with its split and whether it should be declined."""
    sp = table(s, d, "repos").where(F.col("split").isNotNull()).select(C.repo_key(F.col("repo")).alias("repo"), "split").distinct()
    q = C.questions(s, d).join(sp, "repo").select("question_id", "split", (F.coalesce(F.size("expected"), F.lit(0)) <= 0).alias("should"))
    return checkpointed(features(s, d).join(q, "question_id"))


def _confusions(s, d):
    return V.confusions(_rows(s, d), V.grid(s, V.RULES))


def _chosen(s, d):
    return V.chosen_thresholds(_confusions(s, d))


def _policies(s, d):
    """What every pair of coverage thresholds would do with the questions of a split."""
    return QN.policy_grid(_rows(s, d), PAIRS)


def _disagreements(s, d):
    """Per-label counts of human and judge, and the claims on which they disagree."""
    return V.label_counts(_judged(s, d), LABELS)


def _judged(s, d):
    """Labels of claims, and a judge that goes by the length of the claim; a claim without rationale has no judgement."""
    sup = table(s, d, "support").dropDuplicates(["support_id"]).where("label IS NOT NULL")
    k = F.pmod(F.length("claim"), F.lit(4))
    judge = F.when(F.col("rationale").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in LABELS]), k + 1))
    return sup.select(F.upper("label").alias("human"), judge.alias("judge"))


QUERIES = {
    "eval_question_scores": _scores,
    "eval_aggregate": _aggregate,
    "eval_confusions": _confusions,
    "eval_thresholds": _chosen,
    "eval_policies": _policies,
    "eval_agreement": lambda s, d: V.agreement(_judged(s, d), LABELS),
    "eval_label_counts": _disagreements,
    "eval_confusion_matrix": lambda s, d: V.confusion_matrix(_judged(s, d)),
    "eval_syntax_classes": lambda s, d: C.sources(s, d).where(F.col("path").rlike(r"\.jsx?$")).select("file_id", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    .groupBy("file_id", V.syntax_class(F.col("text")).alias("syntax_class")).agg(F.count("*").alias("lines")),
}

_KS = (1, 3, 5, 10)
_SCORES = f"""{LEXICAL}, e AS (SELECT question_id, generate_subscripts(expected, 1) AS item, unnest(expected) AS x FROM q),
m AS (SELECT t.question_id, t.rank, e.item FROM top t JOIN e USING (question_id) WHERE t.path = x.path AND (x.lines[1] IS NULL OR (t.start_line <= x.lines[2] AND t.end_line >= x.lines[1]))),
f AS (SELECT question_id, min(rank) AS first_hit, count(DISTINCT rank) FILTER (rank <= 5) AS hits5 FROM m GROUP BY question_id),
it AS (SELECT question_id, {", ".join(f"count(*) FILTER (r <= {k}) AS items{k}" for k in _KS)} FROM (SELECT question_id, item, min(rank) AS r FROM m GROUP BY question_id, item) GROUP BY question_id),
t5 AS (SELECT question_id, count(*) AS n5 FROM top WHERE rank <= 5 GROUP BY question_id),
sc AS (SELECT q.question_id, q.repo, q.category, coalesce(len(expected), 0) = 0 AS negative, first_hit, {", ".join(f"coalesce(first_hit <= {k}, false) AS hit{k}" for k in _KS)},
  {", ".join(f"round(CASE WHEN len(expected) > 0 THEN coalesce(items{k}, 0) / len(expected) ELSE 0 END, 6) AS recall{k}" for k in _KS)}, round(CASE WHEN n5 > 0 THEN coalesce(hits5, 0) / n5 ELSE 0 END, 6) AS precision5
  FROM q LEFT JOIN f USING (question_id) LEFT JOIN it USING (question_id) LEFT JOIN t5 USING (question_id))"""


def _grid_sql() -> str:
    rows = []
    for rule, axes in V.RULES.items():
        pos = 0
        for a in axes[0]:
            for b in axes[1] if len(axes) > 1 else [None]:
                rows.append(f"('{rule}', {pos}, CAST({a} AS DOUBLE), CAST({'NULL' if b is None else b} AS DOUBLE))")
                pos += 1
    return f"(VALUES {', '.join(rows)}) g(rule, pos, t1, t2)"


_FEATURE_ROWS = f"""{FEATURES}, rw AS (SELECT s.split, coalesce(len(expected), 0) = 0 AS should, ff.* FROM ff JOIN q USING (question_id) JOIN (SELECT DISTINCT trim(lower(repo)) AS repo, split FROM repos WHERE split IS NOT NULL) s USING (repo))"""
_ROWS = f"""{_FEATURE_ROWS},
xr AS (SELECT split, rule, pos, t1, t2, should, CASE rule WHEN 'top_score' THEN top_score < t1 WHEN 'idf_coverage' THEN idf_coverage < t1 WHEN 'top1_coverage' THEN top1_coverage < t1 WHEN 'margin' THEN margin < t1
  WHEN 'no_structure' THEN NOT exact_symbol AND NOT path_hit AND top1_coverage < t1 ELSE idf_coverage < t1 OR top_score < t2 END AS did FROM rw CROSS JOIN {_grid_sql()}),
kx AS (SELECT split, rule, pos, t1, t2, count(*) FILTER (should AND did) AS tp, count(*) FILTER (should AND NOT did) AS fn, count(*) FILTER (NOT should AND did) AS fp, count(*) FILTER (NOT should AND NOT did) AS tn FROM xr GROUP BY ALL),
z AS (SELECT *, round((tp / greatest(1, tp + fn) + tn / greatest(1, tn + fp)) / 2, 9) AS balanced FROM kx)"""
_JUDGED = """j AS (SELECT upper(label) AS human, CASE WHEN rationale IS NOT NULL THEN ['SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'CONTRADICTED'][1 + length(claim) % 4] END AS judge FROM (SELECT DISTINCT ON (support_id) * FROM support) WHERE label IS NOT NULL)"""
_LINES = "\n".join(f"WHEN regexp_matches(text, '{rx}') THEN '{n}'" for n, rx in V.SYNTAX_CLASSES)

SQL = {
    "eval_question_scores": f"WITH {_SCORES} SELECT * FROM sc",
    "eval_aggregate": f"""WITH {_SCORES}, p AS (SELECT coalesce(category, '(none)') AS category, coalesce(repo, '(none)') AS repo, first_hit, precision5, hit1, hit3, hit5, hit10 FROM sc WHERE NOT negative)
SELECT category, repo, CASE grouping(category, repo) WHEN 3 THEN 'all' WHEN 1 THEN 'category' ELSE 'repo' END AS level, count(*) AS questions, {", ".join(f"round(avg(CAST(hit{k} AS DOUBLE)), 6) AS hit{k}" for k in _KS)}, round(avg(precision5), 6) AS precision5, round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr
FROM p GROUP BY GROUPING SETS ((category), (repo), ())""",
    "eval_confusions": f"WITH {_ROWS} SELECT * FROM z",
    "eval_thresholds": f"""WITH {_ROWS}, b AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY round(balanced - 0.001 * fp, 9) DESC, pos) AS rn FROM z WHERE split = 'tuning')
SELECT b.rule, b.pos, b.t1, b.t2, b.tp, b.fn, b.fp, b.tn, b.balanced, h.tp AS holdout_tp, h.fn AS holdout_fn, h.fp AS holdout_fp, h.tn AS holdout_tn, h.balanced AS holdout_balanced FROM b LEFT JOIN z h ON h.split = 'holdout' AND h.rule = b.rule AND h.pos = b.pos WHERE rn = 1""",
    "eval_agreement": f"""WITH {_JUDGED}, s AS (SELECT * FROM j WHERE judge IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (human = judge) AS agree FROM s),
pe AS (SELECT sum((SELECT count(*) FROM s WHERE human = l) / greatest(1, n) * (SELECT count(*) FROM s WHERE judge = l) / greatest(1, n)) AS pe FROM n, (VALUES ('SUPPORTED'), ('PARTIALLY_SUPPORTED'), ('UNSUPPORTED'), ('CONTRADICTED')) v(l))
SELECT n, round(agree / n, 6) AS accuracy, round((agree / n - pe) / (1 - pe), 6) AS kappa, (SELECT count(*) FROM s WHERE human IN ('UNSUPPORTED', 'CONTRADICTED') AND judge NOT IN ('UNSUPPORTED', 'CONTRADICTED')) AS unsafe_agreements,
(SELECT count(*) FROM s WHERE human = 'SUPPORTED' AND judge IN ('UNSUPPORTED', 'CONTRADICTED')) AS over_rejections, (SELECT count(*) FROM j WHERE judge IS NULL) AS unclassified FROM n, pe""",
    "eval_policies": f"""WITH {_FEATURE_ROWS}, g(low, high) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in PAIRS)})
SELECT low, high, CASE WHEN evidence = 0 OR idf_coverage < low THEN 'insufficient' WHEN idf_coverage < high THEN 'caution' ELSE 'answer' END AS decision, count(*) AS questions FROM rw CROSS JOIN g GROUP BY ALL""",
    "eval_label_counts": f"WITH {_JUDGED} SELECT l AS label, count(*) FILTER (human = l) AS human, count(*) FILTER (judge = l) AS judge, count(*) FILTER (human = l AND judge = l) AS both_, count(*) FILTER (human = l AND judge <> l) AS disagreements FROM j, (VALUES ('SUPPORTED'), ('PARTIALLY_SUPPORTED'), ('UNSUPPORTED'), ('CONTRADICTED')) v(l) GROUP BY l",
    "eval_confusion_matrix": f"WITH {_JUDGED} SELECT human, judge, count(*) AS n FROM j WHERE judge IS NOT NULL GROUP BY human, judge",
    "eval_syntax_classes": f"WITH r AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text FROM {D.FILES} WHERE regexp_matches(path, '\\.jsx?$')), c AS (SELECT file_id, CASE {_LINES} ELSE 'other' END AS syntax_class FROM r) SELECT file_id, syntax_class, count(*) AS lines FROM c GROUP BY ALL",
}
