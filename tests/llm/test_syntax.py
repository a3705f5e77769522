"""Grammar cases, recovery and the stored results of problem 1."""

import json
import random

import pytest

from quarrykit.llm import syntax as S
from quarrykit.llm.jsgrammar import check

VALID = {
    "js": [
        "", "#!/usr/bin/env node\nlet a = 1", "a = b / c / d; x = /re[/]x/g.test(s)", "if (x) /re/.test(y)", "let {a = 1, ...r} = b; [a, , b] = c; ({a = 2} = d)", "for (const [k, v] of m) continue",
        "label: for (;;) break label", "async () => { for await (const x of y) ; }", "class A extends B { static #p = 1; get x() { return this.#p } static { f() } async *g() { yield* h() } 'q'() {} [k] = 2 }",
        "x = a ? b : c ? d : e; y ??= 1; z = (a ?? b) || c; (-2) ** 2", "export default class {}\nexport * as n from 'm'; import d, { a as b } from 'x'; import('y'); import.meta.url", "tag`a${`b${c}`}d`; `\\u{1F600}`",
        "const e = <a.b x='1' {...p} y={<c/>}>Don't {/* c */} stop<></></a.b>", "var async = 1, of = 2, get = 3; async(of); ({get, set: 1, async a() {}, *b() {}, get c() { return 1 }, set c(v) {}})", "a\n++b", "return_ = 1\n(function () { return\n1 })()",
        "let x = y\n/z/g.exec(w)", "try { } catch { } finally { }", "switch (a) { case 1: default: case 2: }", "0x1F + 0b11 + 0o7 + 1_000n + .5e-3", "new new A()(); new A.b.c", "x = { __proto__: null, 'a': 1, 2: 3, [b]: c, d, ...e }",
    ],
    "ts": [
        "let a: Map<string, Array<number>> = new Map<string, Array<number>>()", "type A<T> = T extends (infer U extends string)[] ? U : never; type M = { readonly [K in keyof T as `x${K}`]?: T[K] }", "function f(this: X, a?: number, ...r: string[]): a is string { return <any>a }",
        "abstract class A<T> extends B<T> implements C, D { private constructor(readonly x: number, public y?: string) { super() } abstract m(): void; declare z: number; [k: string]: any; static #q?: number }",
        "enum E { A = 1, B = A << 1 } const enum F { X = 'x' } declare module 'm' { export const a: number } namespace N.M { export let x }", "let x = a as const satisfies B; y!.z![0]!(); f<T>(a); new A<B<C>>(); const g = <T,>(a: T): T => a",
        "import type { A } from 'a'; import { type B, C } from 'b'; export type { D } from 'd'; import fs = require('fs'); export = x", "let t: [a: string, b?: number, ...c: boolean[]]; let u: unique symbol; let v: typeof import('x'); let w: abstract new () => void",
        "function o(a: string): void; function o(a: any) {}", "const c = a ? (b) : d => e; const h = a ? (b): c => d : e", "@dec() class K { @inp() x = 1; constructor(@inj(A) private a: A) {} }", "let a = b < c, d = e > (f)", "type F = (a: number, b?: string) => asserts a is string; let z: A.B<C>['k'][]",
    ],
    "tsx": ["const A = <T extends object>(p: P<T>) => <B<T> {...p}>{x as any}</B>", "let f = <T,>(x: T) => x"],
    "flow": ["// @flow\ntype A = {| +a: ?string, b?: number, ... |}; export type B<T: Object = {}> = Array<T>; opaque type C: string = string", "import typeof X from 'x'; import { type Y } from 'y'; const a = (b: any); function f(x: mixed): boolean %checks { return !!x }",
             "declare function g(x: number): string; declare class H { m(): void } declare export default class I {}", "const h = (x: number): (string => void) => y"],
}
INVALID = {
    "js": [
        "let = ", "const a;", "if (a {", "a ? b", "x = 'abc", "`abc", "/* abc", "/abc", "/(/", "/a/gg", "return 1", "break", "class { }", "({a = 1})", "1 = a", "a ?? b || c", "-a ** b", "try { }", "function () {}", "for (const a of b, c) ;", "import a from b", "export const",
        "<a></b>", "<a>x > y</a>", "<a>}</a>", "a b", "interface A {}", "let a: number", "\\x", "{ (}", "switch (a) { default: default: }", "async () => { await }", "'\\u{zz}'", "3in [] ; 3a", "f(a b)", "<<<<<<< HEAD", "new.foo", "else {}", "let [a]", "x = {a b}", "throw\na",
    ],
    "ts": ["let a: = 1", "type A = ", "interface { }", "let a = <b>c</b>", "function f(a: ) {}", "enum { A }", "class A { private }  }", "let x: Map<string", "const a: number"],
    "tsx": ["let a = <b>", "let a = <b c=>x</b>"],
    "flow": ["type A = {| a: string }"],
}


@pytest.mark.parametrize("dialect", VALID)
def test_valid(dialect):
    for t in VALID[dialect]:
        assert check(t, dialect) == [], t


@pytest.mark.parametrize("dialect", INVALID)
def test_invalid(dialect):
    for t in INVALID[dialect]:
        assert check(t, dialect), t


def test_recovery_finds_every_error():
    text = "let a = ;\nlet b = 1;\nlet c = ) ;\nfunction f() { return 1 }\nlet d = 'x\nlet e = 2;\n"
    lines = [e["line"] for e in S.parse("a.js", text)["errors"]]
    assert lines == [1, 3, 5]


def test_never_hangs_on_noise():
    rng = random.Random(2)
    parts = ["{", "}", "(", ")", "<", ">", "/", "`", "'", '"', "${", "let", "class", "=>", "async", "\n", "a", "1", ":", "?", "@", "#x", "//", "/*", "*/", "</a>", "import", "export", "type", "[", "]", ";"]
    for _ in range(1500):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        for d in ("js", "flow", "ts", "tsx"):
            check(t, d)


def test_deep_and_long_texts():
    assert S.parse("a.js", "[" * 50_000 + "]" * 50_000)["status"] == "valid"
    assert S.parse("a.js", "x = " + "[" * 3_000)["status"] == "invalid" and S.parse("package.json", "[" * 20_000)["status"] == "invalid"
    assert S.dialect_of("a.js", "/*" + " licence\n" * 9_000 + " @flow */\nlet a: number;") == "flow"
    assert S.parse("a.js", "a = 1;\n" * 50_000)["status"] == "valid"
    assert S.parse("a.js", "x = " + "a + " * 20_000 + "b")["status"] == "valid"


def test_json_random():
    rng = random.Random(4)
    base = json.dumps({"a": [1, 2.5, -3e2, True, None, "x\né"], "b": {"c": {}, "d": []}})
    for _ in range(800):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(t))
            t[i] = rng.choice(["", "}", "]", ",", '"', "x", "0", ":", "\n"])
        s = "".join(t)
        try:
            json.loads(s)
            ok = True
        except ValueError:
            ok = False
        assert (not S.check_json(s, False)) == ok, s
    assert not S.check_json('{ // c\n "a": [1, 2,], /* d */ }', True) and S.check_json("{,}", True) and S.check_json("", False)


def test_dialects():
    d = S.dialect_of
    assert d("a/b.mjs", "/* x\n @flow */ let a: number") == "flow" and d("a.js", "// a\n// @flow strict\n") == "flow" and d("a.js", "let a; // @flow") == "js"
    assert d("a.tsx", "") == "tsx" and d("x/package.json", "") == "json" and d("tsconfig.base.json", "") == "jsonc" and d("a.md", "") is None and d(None, "") is None and d("jsconfig.json", "") is None


def test_frame_with_dirt(spark):
    data = [(1, 1, "r", "a.js", "let a ="), (1, 1, "r", "a.js", "let a ="), (2, None, None, "b.ts", "﻿let a: number"), (3, 1, "r", "c.js", None), (4, 1, "r", "package.json", ""), (5, 1, "r", None, "let"), (6, 1, "r", "x.md", "# <"), (7, 1, "r", "d.js", "let a: number;")]
    df = spark.createDataFrame([(*r, "clash") for r in data], "file_id BIGINT, build_id BIGINT, repo STRING, path STRING, content STRING, status STRING")
    assert sorted(r.file_id for r in S.invalid_files(df).collect()) == [1, 4, 7]
    got = {r.file_id: r for r in S.parse_files(df).collect()}
    assert got[1].first_cause == "truncated" and "ts" in got[7].accepted_by and got[3].status == "valid"
    assert S.rates(df.where("false")).count() == 0


def test_all_json_errors_acceptance_and_cause():
    assert [a for a, _ in S.check_json('[1, x, {"a" 1, "b": ?}, 2 3]', False)] == [4, 12, 20, 26]
    assert len(S.check_json('{"a": [1, 2}, "b": }', False)) == 2 and S.check_json("[1] 2", False) and S.check_json("[1,]", False)
    assert S.parse("a.ts", "export const a = 1;")["accepted_by"] == ["js", "flow", "ts", "tsx"] and S.parse("a.js", "export const a = 1;", False)["accepted_by"] == ["js"]
    assert S.parse("a.js", "/*\n=======\n*/\nfunction f() {")["first_cause"] == "truncated"
    assert S.parse("a.js", "f();\n<<<<<<< HEAD\ng();\n=======\nh();\n>>>>>>> x\n")["first_cause"] == "merge-conflict"
