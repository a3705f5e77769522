"""The token scan and the operators of prompts and questions on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import prompt as PR
from quarrykit.operators import questions as Q
from quarrykit.operators.extract import Unbalanced, extract, merged_chunks


def names(text, **kw):
    return [(s["name"], s["kind"], s["start_line"], s["end_line"], s["exported"], s["qualified_name"]) for s in extract(text, **kw).symbols]


def test_es_module():
    t = "import a, { b as c } from './x';\nexport default function main() {\n}\nexport class K extends B {\n  #p = 1;\n  run(x) { return `}${x}`; }\n  static go = async () => {\n  };\n}\nexport const f = (a) => a, n = 3;\nconst g = function () {};\nexport { n as m } from './y';\nexport * from './z';\ninterface I { a: string }\nexport enum E { A }\ntype T = { b: 1 };\n"
    got = names(t)
    assert ("main", "function", 2, 3, True, "main") in got and ("K", "class", 4, 9, True, "K") in got and ("run", "method", 6, 6, True, "K.run") in got and ("go", "method", 7, 8, True, "K.go") in got
    assert ("f", "function", 10, 10, True, "f") in got and ("n", "variable", 10, 10, True, "n") in got and ("g", "function", 11, 11, False, "g") in got
    assert {k for _, k, *_ in got} >= {"interface", "enum", "type"}
    x = extract(t)
    assert {(i[0], i[1]) for i in x.imports} == {("./x", "esm"), ("./y", "reexport"), ("./z", "reexport")} and {e[0] for e in x.exports} >= {"default", "K", "f", "n", "m", "*", "E"}


def test_commonjs():
    x = extract("const { a } = require('./a');\nmodule.exports = { a, b: 1 };\nexports.c = function () {\n};\nthing.run = () => 1;\nimport('./late');\n")
    assert {(i[0], i[1]) for i in x.imports} == {("./a", "require"), ("./late", "dynamic")} and {e[0] for e in x.exports} == {"default", "a", "b", "c"}
    assert {s["qualified_name"] for s in x.symbols} >= {"exports.c", "thing.run"}


def test_strings_comments_and_regex_do_not_count():
    assert names("const a = '}'; // }\n/* { */ const r = /[{(]/g;\nfunction f() { return `{`; }\n")[-1][:4] == ("f", "function", 3, 3)
    for bad in ("function f() {", "a)", "`x", "(]"):
        with pytest.raises(Unbalanced):
            extract(bad)
    assert extract("").symbols == []


def test_chunks_cover_files():
    rng = random.Random(3)
    for _ in range(60):
        t = "".join(rng.choice(["function f%d() {\n%s}\n", "class C%d {\n%s}\n", "\n// c%d\n%.0s", "const x%d = 1;\n%.0s"]) % (i, "  m() {\n  }\n" * rng.randint(0, 40)) for i in range(rng.randint(1, 8)))
        n = t.count("\n")
        c = merged_chunks(extract(t).units, n)
        assert [x for a, b in c for x in range(a, b + 1)] == list(range(1, n + 1))


def test_prompt_round_trip(spark):
    ev = [("E1", 'a "b".ts', 3, 4, "x\n@@0123 END E1"), ("E2", "c.ts", 1, 1, "")]
    df = spark.createDataFrame([(1, "q\nr", "o/r", "s", ev, ["n\nm"]), (2, "q", "o/r", "s", [], [])], "question_id INT, question STRING, repo STRING, sha STRING, evidence ARRAY<STRUCT<evidence_id: STRING, path: STRING, start_line: INT, end_line: INT, text: STRING>>, notes ARRAY<STRING>")
    p = PR.built(df)
    got = sorted(tuple(r)[1:] for r in PR.read_back(p).collect())
    assert got == sorted(ev)
    text = {r.question_id: r for r in p.collect()}
    assert "NO_EVIDENCE" in text[2].prompt and "INDEX n m" in text[1].prompt and text[1].prompt.count(text[1].marker) == 8


def test_affirmed_and_judged(spark):
    df = spark.createDataFrame([("It does not leak. It leaks here",), ("it never leaks",), ("no. however it leaks",), ("x",)], "t STRING")
    assert [r[0] for r in df.select(PR.affirmed(F.col("t"), "leaks?")).collect()] == [True, False, True, False]
    df = spark.createDataFrame([('a {"label": "SUPPORTED"} b',), ('{"label": "GOOD"}',), ("",), (None,)], "t STRING")
    assert [r[0] for r in df.select(PR.judged(F.col("t"))).collect()] == ["SUPPORTED", None, None, None]


def test_package_choice(spark):
    p = spark.createDataFrame([("o/kit", "kit"), ("o/kit", "@s/other"), ("o/one", "solo")], "repo STRING, package STRING")
    q = spark.createDataFrame([("o/kit", 1, "What is the entry point of other?"), ("o/kit", 2, "What is the entry point?"), ("o/one", 3, "main file?"), ("o/kit", 4, "Where is x?"), ("o/kit", 5, "entry point of kit and other?")], "repo STRING, question_id INT, question STRING")
    assert {r.question_id: r.package for r in Q.chosen_package(q, p).collect()} == {1: "@s/other", 2: "kit", 3: "solo"}


def test_quoted_lines(spark):
    from quarrykit.functions.text import quoted_lines

    df = spark.createDataFrame([("a\n b  c\n\nd e\nf", "c d"), ("a\nb", "zz"), ("x\nlong line\nlong line", "L7| long line"), ("ab", "ab")], "b STRING, q STRING")
    got = [r[0] and tuple(r[0]) for r in df.select(quoted_lines(F.col("b"), F.lit(10), F.col("q"))).collect()]
    assert got == [(11, 13), None, (11, 11), None]


def test_records_and_reviews(spark):
    rec = spark.createDataFrame([(1, "quote too long", "x"), (2, None, "y"), (3, "other", "z")], "reply_id INT, reason STRING, note STRING")
    new = spark.createDataFrame([(1, None), (2, "never")], "reply_id INT, reason STRING")
    assert {r.reply_id: r.reason for r in Q.validated_again(rec, new).collect()} == {1: None, 2: None, 3: "other"}
    fresh = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT")
    assert {r.k: r.verdict for r in Q.kept_verdicts(fresh, spark.createDataFrame([("a", "ok")], "k STRING, verdict STRING"), ["k"]).collect()} == {"a": "ok", "b": None}
    with pytest.raises(Exception, match="would be lost"):
        Q.kept_verdicts(fresh, spark.createDataFrame([("c", "ok")], "k STRING, verdict STRING"), ["k"]).collect()


def test_fixture_and_entry_blocks(spark):
    res = spark.createDataFrame([(1, 1, "a"), (2, 1, "bad")], "question_id INT, rank INT, path STRING")
    exp = spark.createDataFrame([(1, "a", []), (2, None, ["bad"]), (3, None, ["bad"])], "question_id INT, path STRING, hostile ARRAY<STRING>")
    assert {r.question_id: r.passed for r in Q.fixture_passes(res, exp).collect()} == {1: True, 2: False, 3: True}
    m, e = spark.createDataFrame([(1, 7, 3)], "question_id INT, file_id INT, line INT"), spark.createDataFrame([(1, 8, 1)], "question_id INT, file_id INT, line INT")
    ch = spark.createDataFrame([(70, 7, 1, 5), (80, 8, 1, 9)], "chunk_id INT, file_id INT, start_line INT, end_line INT")
    none = spark.createDataFrame([], "question_id INT, file_id INT, start_line INT, end_line INT")
    assert [(r.chunk_id, r.place) for r in Q.entry_blocks(m, e, ch, none).orderBy("place").collect()] == [(70, 1), (80, 2)]
    assert [r.chunk_id for r in Q.entry_blocks(m, e, ch, spark.createDataFrame([(1, 7, 1, 4)], none.schema)).collect()] == [80]
