"""Problems 2, 3, 5, 6, 7 and 8 on small fixtures, against brute force where there is one."""

import random

import pytest
from pyspark.sql import functions as F

from quarrykit.llm import boundaries as B
from quarrykit.llm import handwritten as H
from quarrykit.llm import leakage as L
from quarrykit.llm import nearsplit as N
from quarrykit.llm import packing as K
from quarrykit.llm import subjects as U
from quarrykit.llm.alignment import smith_waterman, words
from quarrykit.llm.origin import claims, evidence, fingerprints, tokens
from quarrykit.llm.wording import canonical, osa, same

FILES = "file_id BIGINT, repo STRING, path STRING, content STRING, reasons STRING"


# ---- 2
def library(seed, n=40):
    rng = random.Random(seed)
    w = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))

    def expr(d):
        k = rng.randint(0, 5) if d else 0
        return w() if k == 0 else f"{w()}({expr(d - 1)}, {expr(d - 1)})" if k == 1 else f"({expr(d - 1)} {rng.choice('+-*')} {expr(d - 1)})" if k == 2 else f"{w()}.{w()}" if k == 3 else f"[{expr(d - 1)}]" if k == 4 else str(rng.randint(1, 99))

    def line():
        k = rng.randint(0, 3)
        return f"  const {w()} = {expr(3)};" if k == 0 else f"  if ({expr(2)}) return {expr(2)};" if k == 1 else f"  while ({expr(1)}) {{ {w()} = {expr(2)}; }}" if k == 2 else f"  {w()}({expr(2)});"

    return "\n".join(f"function {w()}({w()}) {{\n" + "\n".join(line() for _ in range(rng.randint(2, 6))) + f"\n  return {expr(2)};\n}}" for _ in range(n))


def test_vendored_copies_changed_or_not(spark):
    lib = library(1)
    data = [(i, f"owner{i}/x", "src/util.js", lib) for i in range(4)]
    data += [(10, "owner9/y", "src/own.js", library(2)), (11, "owner9/y", "src/changed.js", "// local patch\n" + lib.replace("return", "return 1 +", 2)), (12, "same/a", "src/s.js", library(3)), (13, "same/b", "src/s.js", library(3)), (14, "same/c", "src/s.js", library(3)),
             (15, None, None, None), (16, "r/r", "e.js", ""), (10, "owner9/y", "src/own.js", library(2))]
    df = spark.createDataFrame([(*r, "clash") for r in data], FILES)
    assert sorted(r.file_id for r in H.not_handwritten(df).collect()) == [0, 1, 2, 3, 11]
    assert H.not_handwritten(df.where("false")).count() == 0


def test_evidence_in_the_file():
    ev = lambda path, text: evidence(path, text, tokens(text))
    body = "export function add(first, second) {\n  return first + second;\n}\n"
    assert "generated-header" in ev("a.ts", "// Code generated by protoc v1.2; DO NOT EDIT.\n" + body)
    assert ev("a.ts", "// skip every file whose header says @generated\n" + body) == [] and ev("a.ts", body + 'const x = "Code generated by y. DO NOT EDIT.";') == []
    assert "generated-trailer" in ev("lib/a.js", body + "\n// ledgergen: 176 lines emitted, do not edit\n") and "generated-trailer" in ev("a.ts", body + "// end of output of ledgergen") and ev("a.ts", body + "// the step closes it: })") == []
    assert "data" in ev("a.js", "module.exports = [" + "0x1f, " * 200 + "];") and ev("a.js", "const t = [1, 2, 3];\n" + body) == []
    assert "package-path" in claims("node_modules/x/i.js", body) and claims("src/vendors/a.js", "import x from './y';\n" + body) == [] and ev("src/vendors/a.js", "import x from './y';\n" + body) == []
    assert "minified" in ev("a.js", "(function(e,t){" + "var n=e.a(t);if(!n){t=e}return n?e(t):t;" * 30 + "})()")
    assert "generated-trailer" in ev("lib/a.js", body + "\n/* end of output of ledgergen\n" + "words " * 900 + "*/\n")
    assert "library-banner" in claims("a.js", "/*! left-pad v1.2.3 | MIT */\n" + body)


def test_winnowing_guarantee():
    rng = random.Random(6)
    a = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(300)]
    common = [f"c{i}" for i in range(20 + 24 - 1)]
    x, y = a[:150] + common + a[150:], common + a[::-1]
    assert set(fingerprints(x)) & set(fingerprints(y)) and fingerprints(a[:5]) == []


# ---- 3
def test_segment_join_finds_all_within_k():
    rng = random.Random(8)
    for _ in range(400):
        s = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
        t = list(s)
        for _ in range(rng.randint(0, N.edits_for(len(s)))):
            i = rng.randint(0, len(t))
            op = rng.randint(0, 2)
            if op == 0:
                t.insert(i, rng.choice("abc"))
            elif t:
                t[min(i, len(t) - 1)] = rng.choice("abc") if op == 1 else ""
                t = [c for c in t if c]
        t = "".join(t)
        if t:
            assert set(N.segment_keys("q", s)) & set(N.substring_keys("q", t)), (s, t)


def test_same_and_different():
    repos = frozenset(["store-kit", "other-js"])
    common = frozenset("harbor mask span slot load entry".split())
    can = lambda t: canonical(t, repos)
    base = "How does store-kit load the harbor mask entry when no span was sent?"
    for t in ["Q: how does other-js load harbor mask entry whenever no span was sent", "How does sotre-kit load the harbor  mask entry when no span was sent?? Name the file.", "[note] How does store-kit laod the hrabor mask entry when no span was sent (see code)"]:
        assert same(can(base), can(t), common), t
    for t in ["How does store-kit load the harbor slot entry when no span was sent?", "Where is the harbor mask entry defined?", "How does store-kit load the harbor mask entry when no slot was sent?"]:
        assert not same(can(base), can(t), common), t
    assert can("") == [] and can(None) == [] and osa("ab", "ba", 2) == 1 and osa("abc", "xyz", 2) == 3


def test_pairs_across_splits(spark):
    repos = spark.createDataFrame([("a/one", "tuning"), ("b/two", "holdout"), ("c/three", None), ("a/one", "tuning")], "repo STRING, split STRING")
    q = [(1, "A/One.git ", "Where is the cache mask updated?"), (2, "b/two", "where is the cache mask  updated??"), (3, "c/three", "Where is the cache mask updated?"), (4, "b/two", "Which modules import parseThing?"), (5, "b/two", None), (6, "a/one", ""), (2, "b/two", "where is the cache mask  updated??"), (7, None, "Where is the cache mask updated?")]
    qs = spark.createDataFrame([(*r, "x") for r in q], "question_id BIGINT, repo STRING, question STRING, split STRING")
    sup = spark.createDataFrame([(1, "a/one", "The mask is kept until none was sent."), (9, "b/two", "The mask is kept until none was sent.")], "support_id BIGINT, repo STRING, claim STRING")
    assert sorted(tuple(r) for r in N.found_pairs(qs, sup, repos).collect()) == [("question", 1, 2), ("support", 1, 9)]
    assert N.found_pairs(qs.where("false"), sup.where("false"), repos).count() == 0
    assert {(r.split, r.repo): r.pairs for r in N.counts(qs, sup, repos).where("record_kind = 'question'").collect()} == {("holdout", "b/two"): 1, ("tuning", "a/one"): 1}


# ---- 5
def test_pieces_cover_and_overlap():
    rng = random.Random(9)
    for _ in range(300):
        start, n = rng.randint(1, 50), rng.randint(1, 900)
        limit, overlap = rng.choice([(80, 5), (10, 3), (7, 0), (3, 2)])
        p = B.pieces([rng.randint(0, 50) for _ in range(n)], start, start + n - 1, limit, overlap)
        assert p[0][0] == start and p[-1][1] == start + n - 1 and all(1 <= b - a + 1 <= limit for a, b in p)
        for (a, b), (c, d) in zip(p, p[1:]):
            assert c == max(start, b + 1 - overlap) and d > b


def test_cuts_at_boundaries():
    block = "function f() {\n" + "  a();\n" * 30 + "}\n\n"
    st = B.strengths(block * 4)
    p = B.pieces(st.tolist(), 1, len(st))
    lines = (block * 4).split("\n")
    assert all(lines[b - 1].strip() in ("", "}") for _, b in p[:-1])
    assert B.strengths("").tolist() == [] and B.strengths("x").tolist() == [0]


def test_items_with_dirt(spark):
    long = "a();\n" * 100
    files = spark.createDataFrame([(1, "r", long), (1, "r", long), (2, "r", None), (3, "r", "")], "file_id BIGINT, repo STRING, content STRING")
    sym = [(1, 1, "r", 1, 100), (1, 1, "r", 1, 100), (2, 1, "r", 1, 80), (3, 1, "r", 21, 500), (4, 1, "r", 1, None), (5, 2, "r", 1, 200), (6, 9, "r", 1, 200), (7, 1, "r", 50, 20), (8, 1, "r", 10, 90)]
    s = spark.createDataFrame([(*r, "clash") for r in sym], "symbol_id BIGINT, file_id BIGINT, repo STRING, start_line INT, end_line INT, item_kind STRING")
    c = spark.createDataFrame([(1, 1, "r", 1, 500)], "chunk_id BIGINT, file_id BIGINT, repo STRING, start_line INT, end_line INT")
    assert sorted(tuple(r) for r in B.found_items(files, s, c).collect()) == [("chunk", 1), ("symbol", 1), ("symbol", 8)]
    assert B.split_items(files.where("false"), s, c).count() == 0


# ---- 6
def test_packing_random():
    rng = random.Random(11)
    for _ in range(60):
        sizes = [rng.randint(0, 100) for _ in range(rng.randint(0, 60))]
        bins = K.pack(sizes, 100, 400)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len([b for b in bins if any(sizes[i] for i in b)]) <= len(K.best_fit([s for s in sizes if s], 100))


def test_branch_and_bound_beats_best_fit():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert len(K.best_fit(sizes, 61)) == 4 and len(K.pack(sizes, 61)) == 3
    hard = [49, 41, 34, 33, 29, 26, 26, 22, 20, 19]  # 299 in containers of 100: best fit decreasing takes 4
    assert len(K.best_fit(hard, 100)) == 4 and len(K.pack(hard, 100)) == 3


def test_packed_texts(spark):
    long = " ".join(f"word{i}" for i in range(3_000))
    docs = [(1, "short text"), (2, long), (3, ""), (4, None), (5, "x" * 9_000), (6, "short text"), (1, "short text")]
    got = K.packed(spark.createDataFrame([(*d, 0) for d in docs], "doc_id BIGINT, text STRING, tokens INT")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece_no, r.start_char, r.end_char, r.tokens))
    assert set(by) == {1, 2, 3, 4, 5, 6}
    text = dict(docs)
    for i, p in by.items():
        p.sort()
        assert "".join((text[i] or "")[a:b] for _, a, b, _ in p) == (text[i] or "") and (len(p) == 1 or i in (2, 5))
    per = {}
    for r in got:
        per[r.container_id] = per.get(r.container_id, 0) + r.tokens
    assert max(per.values()) <= 2048
    assert all(long[b] == " " for _, _, b, _ in by[2][:-1])


# ---- 7
def test_words_whatever_the_dress():
    assert words("**The** qu​ick <b>bro</b>wn [fоx](http://x.y) JUM-\nPED &amp; ｒan") == ["the", "quick", "brown", "fox", "jumped", "ran"]
    assert words(None) == [] and words("") == []


def test_smith_waterman_by_hand():
    a = "the quick brown fox jumps over".split()
    assert smith_waterman(a, "x quick brown cat jumps over y".split())[0] == 4
    assert smith_waterman(a, ["z"])[0] == 0 and smith_waterman([], a)[0] == 0


def test_leaks(spark):
    rng = random.Random(13)
    w = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(w) + str(rng.randint(0, 50)) for _ in range(40)] for i in range(3)}
    noise = lambda n: [rng.choice(w) for _ in range(n)]
    changed = [x if k % 9 else "zzz" for k, x in enumerate(items[0])]
    docs = [(1, " ".join(noise(50) + changed + noise(50))), (2, " ".join(items[1][:12] + noise(30))), (3, " ".join(items[1][:14] + noise(80) + items[1][14:30])), (4, ""), (5, None), (6, " ".join(items[2][:22]).upper()), (6, " ".join(items[2][:22]).upper())]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id BIGINT, text STRING, item_id BIGINT")
    p = spark.createDataFrame([(i, "r", "k", " ".join(x)) for i, x in items.items()] + [(9, "r", "k", None)], "item_id BIGINT, repo STRING, kind STRING, text STRING")
    assert sorted(tuple(r) for r in L.found(d, p).collect()) == [(1, 0), (3, 1), (6, 2)]
    assert L.found(d.where("false"), p).count() == 0
    assert {r.item_id: r.documents for r in L.leaked_items(d, p).collect()} == {0: 1, 1: 1, 2: 1, 9: 0}


# ---- 8
def test_subjects_spread_over_terms(spark):
    rng = random.Random(15)
    vocab = {"law": [f"law{c}x" for c in "abcdefgh"], "music": [f"mus{c}x" for c in "abcdefgh"]}
    sent = lambda s: f"Users asked for {rng.choice(vocab[s])} because {rng.choice(vocab[s])} follows {rng.choice(vocab[s])}."
    plain = "Thanks to everyone who reported this."
    docs, labels, truth = [], [], {}
    for i in range(120):
        kinds = [["law"], ["music"], ["law", "music"]][i % 3]
        docs.append((i, " ".join([sent(s) for s in kinds for _ in range(6 // len(kinds))] + [plain])))
        truth[i] = set(kinds)
        if i < 40 and len(kinds) == 1:
            labels.append((i, kinds[0].upper()))
    docs += [(500, ""), (501, None), (502, plain * 3)]
    labels += [(0, "nonsense"), (9999, "law")]
    d = spark.createDataFrame([(*x, "r", "s") for x in docs], "doc_id BIGINT, text STRING, repo STRING, subject STRING")
    lab = spark.createDataFrame(labels, "doc_id BIGINT, subject STRING")
    sub = spark.createDataFrame([("law", ""), ("music", ""), ("software", "")], "subject STRING, description STRING")
    ev = spark.createDataFrame([(1, "Callers of TenantEdge may scan twice.")], "item_id BIGINT, text STRING")
    got = {}
    for r in U.document_subjects(d, lab, sub, ev).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == t for i, t in truth.items()) >= 114
    assert not {500, 501, 502} & set(got)
    assert U.document_subjects(d.where("false"), lab, sub, ev).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_labels(spark):
    """Every second hand label is held back; most of them must come out."""
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    lab = t("doc_labels").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = {(r.doc_id, r.subject) for r in U.document_subjects(t("documents"), lab.where("not held"), t("subjects"), t("eval_passages")).collect()}
    want = {(r.doc_id, r.subject.strip().lower()) for r in lab.where("held").collect()}
    assert len(want & got) / len(want) >= 0.7
