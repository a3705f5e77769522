"""Retrieval, imports, evidence, validation, evaluation and state on small fixtures against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrykit.config import SearchOptions
from quarrykit.operators import evaluation as V
from quarrykit.operators import evidence as E
from quarrykit.operators import imports as M
from quarrykit.operators import index as I
from quarrykit.operators import retrieval as R
from quarrykit.operators import state as S
from quarrykit.operators import validation as X

FILES = {
    "src/store.ts": 'import { parseConfig } from "./config";\nexport class TokenStore {\n  loadToken(id) { return parseConfig(id); }\n}\n',
    "src/config.ts": "export function parseConfig(text) {\n  return text;\n}\n",
    "src/index.ts": 'export { TokenStore } from "./store";\nimport "./missing";\nimport x from "./theme.css";\nimport fs from "node:fs";\n',
    "test/store.test.ts": 'import { TokenStore } from "../src/store";\nconst y = require("../src");\n',
    "empty.ts": "",
}


@pytest.fixture(scope="module")
def files(spark):
    data = [(i, 1, "o/r", "s" * 40, p, None, t, None, None) for i, (p, t) in enumerate(FILES.items(), 1)]
    data.append(data[0])
    return spark.createDataFrame(data, "file_id BIGINT, build_id BIGINT, repo STRING, sha STRING, path STRING, language STRING, content STRING, size_bytes BIGINT, ingested_at TIMESTAMP")


def corpus(spark, files):
    ch = spark.createDataFrame([(i, i, "o/r", 1, None, None) for i in range(1, 6)], "chunk_id BIGINT, file_id BIGINT, repo STRING, start_line INT, end_line INT, term_count INT")
    c = I.chunks(ch, files)
    sym = spark.createDataFrame([("o/r", 1, 1, "TokenStore", "TokenStore", 2), ("o/r", 2, 1, "loadToken", "TokenStore.loadToken", 3), ("o/r", 3, 2, "parseConfig", None, 1)], "repo STRING, symbol_id BIGINT, file_id BIGINT, name STRING, qualified_name STRING, start_line INT")
    src = files.dropDuplicates(["file_id"]).select("file_id", "repo", "sha", "path")
    r = M.resolved(M.import_rows(files), src).where("target_file_id IS NOT NULL").select("repo", "file_id", "target_file_id", F.col("line").alias("edge_pos"))
    ent = spark.createDataFrame([("o/r", 3, "store-kit")], "repo STRING, file_id BIGINT, package STRING")
    return R.Corpus(I.files(files).select("repo", "file_id", "path", "file_class"), c.select("repo", "chunk_id", "file_id", "start_line", "end_line"), I.term_frequencies(c, ["repo", "chunk_id"]), sym, r, ent)


def test_imports_resolve(spark, files, rows):
    src = files.dropDuplicates(["file_id"]).select("file_id", "repo", "sha", "path")
    got = {(r.path, r.specifier): (r.target_file_id, r.resolution) for r in M.resolved(M.import_rows(files), src).collect()}
    assert got[("src/store.ts", "./config")] == (2, "relative:resolved")
    assert got[("src/index.ts", "./store")] == (1, "relative:resolved")
    assert got[("src/index.ts", "./missing")][1] == "relative:unresolved-missing"
    assert got[("src/index.ts", "./theme.css")][1] == "relative:unresolved-asset"
    assert got[("src/index.ts", "node:fs")][1] == "bare:node-builtin"
    assert got[("test/store.test.ts", "../src")] == (3, "relative:resolved")


def test_aliases(spark):
    df = spark.createDataFrame([("@/a/b", "@/*", "src/*"), ("lib", "lib", "src/lib.ts"), ("x", "@/*", "src/*"), ("~a.js", "~*.js", "t/*")], "s STRING, p STRING, t STRING")
    assert [r[0] for r in df.select(M.alias_candidates(F.col("s"), F.col("p"), F.col("t"))).collect()] == ["src/a/b", "src/lib.ts", None, "t/a"]


def test_search_finds_and_ranks(spark, files):
    q = spark.createDataFrame([("o/r", 1, "Where is `parseConfig` defined?"), ("o/r", 2, "What is the entry point of the token store?"), ("o/r", 3, ""), ("o/r", 4, "zzz qqq")], "repo STRING, question_id BIGINT, question STRING")
    got = {}
    for r in R.search(q, corpus(spark, files)).collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.chunk_id, r.score))
    assert sorted(got[1])[0][1] == 2
    assert 3 in [x[1] for x in got[2]]
    assert 3 not in got and 4 not in got
    for v in got.values():
        s = [x[2] for x in sorted(v)]
        assert s == sorted(s, reverse=True)


def test_lexical_lane_equals_brute_force(spark, files):
    c = corpus(spark, files)
    o = SearchOptions(symbols=False, paths=False, import_expansion=False, entry_boost=False, class_weights={})
    q = spark.createDataFrame([("o/r", 1, "parse the token config")], "repo STRING, question_id BIGINT, question STRING")
    post = {}
    for r in c.postings.collect():
        post.setdefault(r.chunk_id, {})[r.term] = r.tf
    n, mean = 4, sum(sum(p.values()) for p in post.values()) / 4  # the empty file has no chunk
    want = {}
    for term in ("parse", "token", "config"):
        df = sum(term in p for p in post.values())
        for cid, p in post.items():
            if term in p:
                tf = p[term]
                want[cid] = want.get(cid, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(p.values()) / mean))
    got = {r.chunk_id: r.bm25 for r in R.search(q, c, o).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}


def test_empty_tables(spark, files):
    e = files.where("false")
    assert M.import_rows(e).count() == 0 and I.files(e).count() == 0
    q = spark.createDataFrame([], "repo STRING, question_id BIGINT, question STRING")
    assert R.search(q, corpus(spark, files)).count() == 0


def test_budget_admission(spark):
    rng = random.Random(1)
    data = [(g, i, rng.randint(1, 60)) for g in range(30) for i in range(rng.randint(1, 15))]
    got = {}
    for r in E.admit(spark.createDataFrame(data, "g INT, r INT, n INT"), "g", ["r"], "n", 4, 100).collect():
        got.setdefault(r.g, []).append(r.r)
    for g in range(30):
        taken, total = [], 0
        for _, r, n in sorted(x for x in data if x[0] == g):
            if len(taken) < 4 and (not taken or total + n <= 100):
                taken.append(r)
                total += n
        assert sorted(got[g]) == taken


def test_random_citations(spark):
    rng = random.Random(7)
    reg = [(1, f"E{i}", "o", "r", "s", f"p{i}", 1 + i, 10 + i, 30, "o", "r", "s", i) for i in range(5)]
    cols = "reply_id INT, evidence_id STRING, owner STRING, repo STRING, sha STRING, path STRING, start_line INT, end_line INT, file_lines INT, want_owner STRING, want_repo STRING, want_sha STRING, pos INT"
    pick = lambda *xs: rng.choice(xs)
    loc = [(1, pick("E0", "E1", "E9"), pick(None, "o", "x"), pick(None, "r"), pick(None, "s", "t"), pick(None, "p0", "p1"), pick(None, 0, 1, 5, 12, 40), pick(None, 2, 9, 11, 35)) for _ in range(600)]
    df = spark.createDataFrame(loc, "reply_id INT, evidence_id STRING, owner STRING, repo STRING, sha STRING, path STRING, start_line INT, end_line INT")
    items = {r[1]: r for r in reg}

    def want(x):
        it = items.get(x[1])
        if not it:
            return "unknown-evidence-id"
        if x[2] not in (None, "o") or x[3] not in (None, "r"):
            return "wrong-repository"
        if x[4] not in (None, "s"):
            return "wrong-sha"
        if x[5] is not None and x[5] != it[5]:
            return "wrong-path"
        if x[6] is None and x[7] is None:
            return None
        a, b = (x[6] if x[6] is not None else x[7]), (x[7] if x[7] is not None else x[6])
        if a < 1 or b < 1:
            return "invalid-line-number"
        if a > b:
            return "reversed-range"
        if b > 30:
            return "range-beyond-file"
        return "outside-evidence-range" if a < it[6] or b > it[7] else None

    got = [(tuple(r[c] for c in df.columns), r.reason) for r in X.check_locators(df, spark.createDataFrame(reg, cols)).collect()]
    assert len(got) == 600 and len({r for _, r in got}) >= 7
    assert all(r == want(x) for x, r in got)


def test_replies_and_verdicts(spark):
    good = '{"status":"answered","claims":[{"text":"t","evidence":[{"citation":"E1","quote":"const a"}]},{"text":"u","evidence":[]}]}'
    raw = [(1, good), (2, "```json\n" + good + "\n```"), (3, "[]"), (4, '{"status":"answered","claims":[{"text":"x","evidence":[{"citation":"E1"}]}]}'), (5, '{"status":"insufficient_evidence","missing":3}'), (6, None), (7, ""),
           (8, '{"status":"answered","claims":[{"text":"x","evidence":[{"citation":"E1","quote":"' + "q" * 401 + '"}]}]}')]
    df = spark.createDataFrame(raw, "reply_id INT, raw STRING")
    got = {r.reply_id: r.reason for r in X.parsed(df, 3).collect()}
    assert got[1] is None and got[2] is None and got[3] == "not a JSON object" and got[4] == "evidence entry malformed" and got[5] == "missing must be a string"
    assert got[6] == got[7] == "not a JSON object" and got[8] is None
    assert {r.reply_id: r.reason for r in X.parsed(df, 2).collect()}[8] == "quote too long"
    ev = spark.createDataFrame([(1, "E1", "x\nconst a = 1", False), (2, "E1", "nothing", True)], "reply_id INT, evidence_id STRING, text STRING, suspect BOOLEAN")
    v = X.verdicts(X.parsed(df, 3), ev)
    st = {(r.reply_id, r.claim_no): r.status for r in v.collect()}
    assert st[(1, 1)] == "cited" and st[(1, 2)] == "uncited" and st[(2, 1)] == "quote-mismatch" and st[(8, 1)] == "invalid-citation"
    assert {r.reply_id: r.answer_status for r in X.answer_status(v).collect()}[1] == "rejected"


def test_scores_by_hand(spark):
    q = spark.createDataFrame([(1, "r", "c", [("a", [5, 6]), ("b", None)]), (2, "r", "c", []), (3, "r", None, None)], "question_id INT, repo STRING, category STRING, expected ARRAY<STRUCT<path: STRING, lines: ARRAY<INT>>>")
    res = spark.createDataFrame([(1, 1, "a", 7, 9), (1, 2, "a", 1, 5), (1, 3, "b", 1, 1)], "question_id INT, rank INT, path STRING, start_line INT, end_line INT")
    s = {r.question_id: r for r in V.question_scores(q, res).collect()}
    assert s[1].first_hit == 2 and not s[1].hit1 and s[1].hit3 and s[1].recall3 == 1.0 and s[1].precision5 == pytest.approx(2 / 3, abs=1e-6)
    assert s[2].negative and s[3].negative
    allrow = [r for r in V.aggregate(V.question_scores(q, res)).collect() if r.level == "all"][0]
    assert allrow.questions == 1 and allrow.mrr == 0.5


def test_kappa(spark):
    rows_ = [("SUPPORTED", "SUPPORTED"), ("UNSUPPORTED", "SUPPORTED"), ("SUPPORTED", None), ("CONTRADICTED", "CONTRADICTED")]
    a = V.agreement(spark.createDataFrame(rows_, "human STRING, judge STRING"), ["SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED"]).first()
    po, pe = 2 / 3, (1 / 3) * (2 / 3) + (1 / 3) * (1 / 3)
    assert (a.n, a.unclassified, a.unsafe_agreements) == (3, 1, 1) and a.kappa == pytest.approx((po - pe) / (1 - pe), abs=1e-6)


def test_bucket_and_windows(spark):
    s, ok, wait = S.bucket_step(None, 0, 1, 1000)
    assert ok
    s, ok, wait = S.bucket_step(s, 400, 1, 1000)
    assert not ok and wait == 600
    assert S.bucket_step(s, 1000, 1, 1000)[1]
    w, ok, _ = S.window_step(None, 5, 1, 100)
    assert ok and S.window_step(w, 50, 1, 100)[1:] == (False, 55) and S.window_step(w, 105, 1, 100)[1]


def test_admission_gives_back_what_it_took():
    a = S.Admission(client=(1, 1000), everyone=(1, 1000), per_day=(5, 10_000), client_day=None)
    assert a.take("x", 0)[0] == "admitted" and a.take("y", 0)[0] == "busy"
    assert a.take("y", 1000)[0] == "admitted"
    a.cool_down(1000, 500)
    assert a.take("z", 1200) == ("model_cooldown", 300)


def test_lru_bytes():
    c = S.LruBytes(300)
    for k in "abc":
        c.put(k, 36)
    assert c.evictions == 0 and c.held == 300
    c.get("a")
    c.put("d", 36)
    assert "b" not in c.entries and c.evictions == 1
    c.put("huge", 5000)
    assert list(c.entries) == ["huge"]


def test_fold_over_null_and_repeated_keys(spark):
    e = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, "a", 0), (4, "a", 5000)], "event_id BIGINT, k STRING, t BIGINT")
    got = {r.event_id: r.admitted for r in S.token_bucket(e, "k", 1, 1000).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_in_flight_sweep(spark):
    e = spark.createDataFrame([(0, 10), (5, 7), (7, 20), (4_000_000, 4_000_001)], "a BIGINT, b BIGINT")
    got = {r.t: r.open for r in S.in_flight(e, "a", "b").collect()}
    assert got == {0: 1, 5: 2, 7: 2, 10: 1, 20: 0, 4_000_000: 1, 4_000_001: 0}


def test_floor_percentile(spark):
    df = spark.createDataFrame([(1, x) for x in range(20)] + [(2, None)], "k INT, v INT")
    assert [tuple(r) for r in V.floor_percentiles(df, ["k"], "v", 0.95).collect()] == [(1, 19)]
