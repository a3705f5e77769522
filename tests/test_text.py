"""Text scalars against plain Python, on chosen and random input."""

import random
import re

from pyspark.sql import functions as F

from quarrykit import config as C
from quarrykit.functions import paths as P
from quarrykit.functions import text as T


def plain_split(s):
    s = re.sub("([a-z0-9])([A-Z])", r"\1 \2", s)
    s = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", s)
    return [x.lower() for x in re.split("[^A-Za-z0-9]+", s) if x]


def plain_stem(t):
    if len(t) > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if len(t) > 4 and t.endswith("sses"):
        return t[:-2]
    if len(t) > 3 and t.endswith("s") and not t.endswith(("ss", "us", "is")):
        return t[:-1]
    return t


def one(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "x STRING")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_split_identifier_random(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abXYZ09_$-é") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["parseHTTPRequest_v2", "", "__a__"]
    assert one(spark, names, T.split_identifier) == [plain_split(n) for n in names]


def test_stems(spark):
    words = "queries classes status analysis boss cats is gas running mapped falling ring bed added stopped useful".split()
    assert one(spark, words, T.fold_plural) == [plain_stem(w) for w in words]
    verbs = dict(zip(words, one(spark, words, T.fold_verb)))
    assert verbs["running"] == "run" and verbs["mapped"] == "map" and verbs["falling"] == "fall" and verbs["ring"] == "ring" and verbs["bed"] == "bed"
    assert verbs["stopped"] == "stop"


def test_terms_drop_stop_words_and_keep_whole(spark):
    assert one(spark, ["const userNames = getUsers()"], T.terms)[0] == ["username", "user", "name", "getuser", "get", "user"]
    assert one(spark, ["", None], T.terms) == [[], None]


def test_question(spark):
    q = "Where is `parseConfig` called, and how does Store.load() work with plain text?"
    assert one(spark, [q], T.question_terms)[0] == ["parseconfig", "parse", "config", "store", "load", "plain", "text"]
    assert one(spark, [q], T.question_identifiers)[0] == ["parseconfig", "store.load", "store", "load"]


def test_lines_and_windows(spark):
    from quarrykit.operators import index as I

    assert one(spark, ["", "a", "a\n", "a\nb", "\n"], T.line_count) == [0, 1, 1, 2, 1]
    df = spark.createDataFrame([(0,), (1,), (50,), (120,)], "n INT")
    got = [[tuple(w) for w in r[0]] for r in df.select(I.windows(F.col("n"))).collect()]
    assert got == [[], [(1, 1)], [(1, 50)], [(1, 50), (51, 100), (101, 120)]]


def test_merge_units_cover_every_line_once(spark):
    from quarrykit.operators import index as I

    rng = random.Random(5)
    data = []
    for i in range(120):
        n = rng.randint(1, 300)
        units = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(1, n)
            units.append((a, min(n, a + rng.randint(0, 90))))
        data.append((i, n, units))
    df = spark.createDataFrame(data, "i INT, n INT, u ARRAY<STRUCT<start: INT, end: INT>>")
    for r in df.select("n", I.merge_units(F.col("u"), F.col("n")).alias("c")).collect():
        lines = [x for c in r.c for x in range(c.start_line, c.end_line + 1)]
        assert lines == list(range(1, r.n + 1))


def test_quotes(spark):
    df = spark.createDataFrame([("L3| const a  =\n 1;", "x\nconst a = 1;\ny"), ("a b", "a c b"), ("ab", "ab"), ("a b c", "a b c")], "q STRING, b STRING")
    assert [r[0] for r in df.select(T.quote_is_verbatim(F.col("q"), F.col("b"))).collect()] == [True, False, False, True]
    assert one(spark, ["x" * 10 + "\n" + "y" * 500, "z" * 500, "short"], T.trim_quote) == ["x" * 10, "z" * 400, "short"]


def test_durations(spark):
    assert one(spark, ["2m52.8s", "500ms", "1h", "soon", "0.1s"], T.duration_ms) == [172800, 500, 3600000, None, 100]


def test_paths(spark):
    paths = ["src/a.test.ts", "node_modules/x/i.js", "package.json", "yarn.lock", "a/b.min.js", "img/x.png", "README.md", "demo/x.tsx", ".env", "tsconfig.build.json", "src/main.ts"]
    got = dict(zip(paths, one(spark, paths, P.skip_reason)))
    assert got["node_modules/x/i.js"] == "vendored" and got["yarn.lock"] == "lockfile" and got["a/b.min.js"] == "minified-name" and got["img/x.png"] == "binary-extension"
    assert got[".env"] == "unsupported-extension" and got["package.json"] is None and got["tsconfig.build.json"] is None and got["src/main.ts"] is None
    cls = dict(zip(paths, one(spark, paths, P.file_class)))
    assert cls["src/a.test.ts"] == "test" and cls["demo/x.tsx"] == "example" and cls["README.md"] == "docs" and cls["package.json"] == "config" and cls["src/main.ts"] == "source"


def test_joined_path(spark):
    df = spark.createDataFrame([("a/b", "../c"), ("", "./x"), ("a", "../../b"), ("a/b", "./../b/./d")], "d STRING, s STRING")
    assert [r[0] for r in df.select(P.joined_path(F.col("d"), F.col("s"))).collect()] == ["a/c", "x", "../b", "a/b/d"]


def test_repo_inputs(spark):
    got = one(spark, ["https://github.com/a/b", "git@github.com:a/b.git", "a/b", "https://github.com/a/b/tree/main/x", "nothing"], P.repo_of_input)
    assert got == ["a/b", "a/b", "a/b", "a/b", None]


def test_word_lists_are_distinct():
    assert len(set(C.QUESTION_WORDS)) == len(C.QUESTION_WORDS)
