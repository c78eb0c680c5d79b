"""Parsers: Python against the interpreter's own, the others on valid and broken files."""

import random
import warnings

import duckdb
import pytest

from graphlens.llm import validity
from graphlens.llm.syntax import errors

GOOD = {
    "py": ["", "﻿x = 1\r\n", "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case A(b=1) | None:\n        pass\n", "with (open(a) as b, c as d):\n    async def f(x, /, y: int = 1, *z, k, **w) -> int: return await x\n", "x = [i for i in range(3) if i] or {**a, 'b': 1}\nprint(*a, sep='')\nx: list[int] = (yield_ := 3)\n", "@a.b(c)\nclass D(E, metaclass=F):\n    x = lambda *a, **k: 0\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a, (b)\n", 'f"{a!r:>{w}}" "b"\nif a: b; c\nelif d: e\nwhile 1:\n    break\nelse:\n    x = 1 if y else 2\n'],
    "js": ["", "const {a, b: [c, ...d] = [], ...e} = f ?? g?.h?.[i]?.(j);", "label: for (const k of await_) { if (k) continue label; else break }", "class A extends (B, C) { #x = 1; static async *g() { yield* h() } get y() { return this.#x } static { z() } }", "export default async (x = 1, {y}) => ({ z: x, [w]() {}, async v() {} })\nexport * as n from 'm'", "a = b\n++c\nreturn_ = /[/\\]]+/g.test(`x ${`y ${z}`} w`)", "do x++; while (x < 5)\nswitch (a) { case 1: b(); default: c() }\ntry { d() } catch { e() } finally { f() }", "if (a) b; else c\nfor (var i = 0, j; i < 3; i++) ;\nnew X\nlet async = async function* () {}\nvoid 0, a >>>= 2"],
    "ts": ["enum A { B = 1, C }\ninterface D<T extends E = F> extends G { readonly h?: (x: number) => void; [k: string]: any }\ntype J = { [K in keyof L]?: M[K] } | N[] & (typeof o)['p'] | `x`;", "abstract class Q<R> implements S, T { constructor(private readonly u: V, w?: X) { super() } abstract y(): z is Date; declare a: B; static c!: D }", "function f<T>(this: U, x: T[]): asserts x is V;\nfunction f(x: any) { return <W>x as unknown as Map<string, Array<number>>; }\nconst g = <T,>(h: T): h is I => !!h!.j;", "import type { A } from './a'; import b = require('b'); export = c;\ndeclare module 'd' { export const e: f }\nnamespace G.H { let i: unique symbol }"],
    "tsx": ["const a = (b: C) => <D e={f} {...g} h='i'><></><J.K />{l ? <m /> : n} text</D>;"],
    "java": ["", "package a.b;\nimport static c.D.*;\n@E(f = {1, 2}, g = H.class)\npublic sealed interface I<T extends J & K> permits L { default <U> int m(U... n) throws O { return 1; } }", "record P(int x, String... y) { P { if (x < 0) throw new IllegalArgumentException(\"\"\"\n  z\"\"\"); } }\nenum Q { A(1) { void f() {} }, B; Q(int... i) {} }", 'class R { int[] a = {1, 2}, b[] = new int[3][]; static { } R() { this(1); } Object f() { for (int i = 0, j; i < 3; i++, j--) continue; for (final var x : y) { } var l = (a < b) ? (int) c : (d, e) -> f::<G>h; return switch (k) { case 1, 2 -> 3; case L m when m.n() -> { yield 4; } default -> throw o; }; } }', "class S { void t() { try (var u = v(); w) { x[0]++; } catch (Y | Z e) { synchronized (this) { } } List<Map<String, ? super A>> b = new ArrayList<>(); if (c instanceof D d && !d.e) lab: while (true) break lab; int f = g >>> 2; h.<I>j().k = 'x'; } }"],
    "go": ['package a\n\nimport (\n\t"b"\n\t. "c"\n)\n\ntype D[T any] struct {\n\t*E\n\tf, g int `h`\n}\n\nfunc (d *D[T]) I(j ...K) (l int, err error) {\n\tif m, ok := n.(O); ok && m < 1 {\n\t\treturn\n\t} else if p {\n\t}\n\tfor i := range 10 {\n\t\tcontinue\n\t}\n\tswitch q := r.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase s <- 1:\n\tcase t := <-u:\n\t}\n\tgo func() { defer v() }()\n\tw := map[string][]X{"y": {1: {2}}, "z": nil}\n\tw["a"][1:2], b = c, *d\n\treturn\n}\n'],
    "rs": ["", "#![a]\nuse b::{self, c::*, d as e};\npub(crate) struct F<'a, T: G + 'a = H>(&'a T) where T: I<J = K>;\nimpl<T> L for M<T> { const N: usize = 1 << 2; fn o(&mut self, p: impl Fn(i32) -> Vec<Vec<u8>>) -> Result<(), Box<dyn Q>> { let r = s.t::<U>()?; if let Some(x @ 1..=5) = y && z { return Ok(()) } match a { B { c, .. } | D(_, e) if e > 1 => {} 'x' => f!(\"{}\", g), _ => unreachable!() } Ok(()) } }", "fn h() { 'l: loop { break 'l; } let (a, mut b) = (1.5e3, [0u8; 4]); for i in 0..n { b[i] += a as u8 } let c = |x: i32, _| -> i32 { x }; let D { e, f: ref g } = h2 else { panic!() }; unsafe { *p = r#\"x\"# } S { a, ..Default::default() }; /* a /* b */ */ if x == (Y { z: 1 }) {} }", "macro_rules! m { ($x:expr) => { $x + 1 }; }\nenum E { A, B(i32), C { d: u8 } = 4 }\nasync fn f() -> impl G { async move { h().await } }\ntrait T: U { type V; fn w(&self) -> Self::V; }"],
}
BAD = {
    "py": ["def f(:\n    pass", "if x:\npass", "x = (1\ny = 2", "print 'x'", "a = = b", "f(a for b in c, d)", "x = 'abc\n", "  x = 1\n y = 2", "else:\n    pass", "return 1", "1 = x", "f() = 1", "def f(a=1, b): pass", "x = 012", "<<<<<<< HEAD\nx = 1", "try:\n    pass\nx = 1", "{% if a %}\nx = 1", "class A:", "for x in y:\n    pass\n  z = 1", "@a\nx = 1", "import a.b as c.d", "break"],
    "js": ["function (", "let x = ;", "if (a { b }", "const a;", "interface A { b: string }", "let a: number = 1;", "class { a b }", "return 1", "a b", "x = `abc", "/* open", "{ a", "1 = x", "a() = 1", "import a from b", "for (;;", "try { }", "{% x %}", "<html></html>", "break;"],
    "ts": ["let a: = 1;", "interface { }", "type A", "enum A { B C }", "function f(a: ) {}", "<html></html>"],
    "java": ["class A {", "int x = 1;", "class A { int }", "class A { void f() { x } }", "class A { void f() { int = 1; } }", "def f(): pass", "class A { void f() { if x { } } }", 'class A { String s = "abc; }', "package a\nclass B {}", "class A { void f() { a + b; } }", "class A { void f() { break; } }"],
    "go": ["", "func f() {}", "package a\nfunc f( {\n}\n", "package a\nx := 1\n", "package a\nfunc f() {\n\tif x\n\t{\n\t}\n}\n", "package a\nvar x = \"abc\n", "package a\nfunc f() {\n", "package a\nclass B {}\n", "package a\nfunc f() { a b }\n", "package a\nfunc f() {\n\tbreak\n}\n"],
    "rs": ["fn f( {}", "let x = 1;", "fn f() { let x = ; }", "fn f() { a b }", "struct A { b }", "fn f() {", "impl { }", "package a;", "fn f() { /* open }", "fn f() -> { }", "use a", "fn f() { let x = 1 }"],
}


SUBSCRIPTS = {
    "py": ["y = x[0]", "y = x[-1], d['k'], d['k', 1]", "for i in x[0]: pass", "z = f()[0][1], [1, 2][0], 'ab'[1]", "x[0], y['a'] = [1, 2], {'a': 1, 'b': [2]}", "print('a', 'b', 'c', 'd' 'e', 'f'.join(x))", "w = {'a': {'b': 1}, 'c': [1, 2]}['c'][0]", "[1, 2]\n[0]", "if x == [1, 2]: y = x[0]\nreturn_ = lambda: [0]"],
    "js": ["y = x[0], d['k'];", "for (const i of x[0]) ;", "z = f()[0][1], [1, 2][0], 'ab'[1], a?.[0]", "function g() { return a[0]; }", "o = { ['a']: 1, ['b']() {}, c: [1, 2] }", "x\n[0]", "f('a', 'b', 'c', 'd'.trim(), `e`)", "w = b ? [0] : c[1]"],
    "ts": ["let y: number = x![0]; let t: [1, 'a'] = [1, 'a'];", "const z = (f() as any)[0]; let q: string[] = d['k']; type R = Q['k'][0];"],
    "java": ["class A { int y = x[0]; int[] a = {1, 2, 3, 4, 5}, b = new int[]{1}; int f() { return a[0] + b[1]; } int[][] c = {{1, 2}, {3}}; }"],
    "go": ["package a\n\nvar y = x[0]\nvar z = []int{1, 2, 3, 4, 5}[0]\nvar m = map[string]int{\"a\": 1, \"b\": 2}[\"a\"]\n\nfunc f() int {\n\tfor i := range x[0] {\n\t}\n\treturn a[0]\n}\n"],
    "rs": ["fn f() -> u8 { let y = x[0]; for i in x[0] { } g(a?[0], [1, 2][0]); vec![1, 2, 3, 4, 5][0] }", "fn g() -> u8 { a[0] }\nconst B: [u8; 2] = [1, 2];"],
}
for _ext, _texts in SUBSCRIPTS.items():
    GOOD[_ext] = GOOD[_ext] + _texts
BAD["py"] += ["x[0 = 1", "y = [1, 2", "y = [1, 2]]", "y = [1 2]", "y = {'a': 1, 'b'}", "f(1, 2, 3, 4 5)", "[1, 2] = x"]
BAD["js"] += ["y = [1, 2", "x[0 = 1", "f(1, 2, 3, 4 5)", "o = { 'a': 1, 'b' }", "o = { [1, 2]: 3 }"]
BAD["go"] += ["package a\nvar z = []int{1, 2, 3, 4 5}\n"]
BAD["java"] += ["class A { int[] a = {1, 2, 3, 4 5}; }"]
BAD["rs"] += ["fn f() { g([1, 2, 3, 4 5]); }"]

FILLER = {
    "py": "FILL = f(1, 2, [3, 4], {'a': 5, 'b': (6, 7)}), g[0]\n",
    "js": "f(1, 2, [3, 4], { 'a': 5, b: 6 }, g[0]);\n",
    "ts": "f(1, 2, [3, 4], { 'a': 5, b: 6 }, g[0]);\n",
    "tsx": "f(1, 2, [3, 4], { 'a': 5, b: 6 }, g[0]);\n",
    "java": "class F { int[] a = {1, 2, 3, 4}; int b = f(1, 2, a[0]); }\n",
    "go": "var _ = f(1, 2, []int{3, 4, 5, 6}, g[0])\n",
    "rs": "const F: u8 = f(1, 2, [3, 4], g[0]);\n",
}


def among_much_code(ext: str, text: str) -> str:
    """A sample with over 5,000 characters of code, before it where the language lets it, else behind."""
    much = FILLER[ext] * (5000 // len(FILLER[ext]) + 1)
    return much + text if ext in ("py", "js", "ts", "tsx") else f"{text}\n{much}"


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in GOOD.items() for t in ts if not t.startswith("\ufeff") and (e != "go" or t)])
def test_valid_among_much_code(ext, text):
    assert errors(among_much_code(ext, text), ext) == []


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid_among_much_code(ext, text):
    assert errors(among_much_code(ext, text), ext) != []


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert errors(text, ext) == []


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(ext, text):
    assert errors(text, ext) != []


def test_python_against_the_interpreter():
    warnings.simplefilter("ignore")
    rows = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where kind = 'source' and file_path like '%.py%'").fetchall()]
    r = random.Random(1)
    cases = [*rows, *(t[: r.randint(0, len(t))] for t in rows), *(t[:k] + t[k + 1 :] for t in rows for k in [r.randint(0, len(t))])]
    wrong = []
    for t in cases:
        try:
            compile(t.lstrip("﻿"), "x", "exec", dont_inherit=True)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        wrong += [t] if ok == bool(errors(t, "py")) else []
    assert len(wrong) <= 0.01 * len(cases)


def test_all_errors_and_lines():
    found = errors("x = 1\ny = = 2\n'''a\nb'''\nz = = 3\n", "py")
    assert [n for n, _ in found] == [2, 5]
    found = errors("/* a\n b */\nlet x = ;\nlet y = 1;\nlet z = ;\n", "js")
    assert [n for n, _ in found] == [3, 5]
    assert errors("x", "unknown") == []


def test_validity_in_spark(spark):
    df = spark.createDataFrame([("r/a.py", "x = 1", "r", "q"), ("r/b.py", "x = = 1", "r", "q"), ("r/b.py", "x = = 1", "r", "q"), ("r/c.JS", "let a: b", "r", "q"), (None, "x", "r", "q"), ("r/d.txt", "(", "r", "q"), ("r/e.go", None, None, "q"), ("r/f.py", "(" * 3000 + ")" * 3000, "r", "q")], "file_path string, text string, repo string, errors string")
    checked = validity.check(df).cache()
    bad = {r.file_path for r in checked.filter("size(errors) > 0").collect()}
    assert {"r/b.py", "r/c.JS", "r/e.go"} <= bad and "r/a.py" not in bad
    row = validity.rates(checked).filter("repo = 'r' AND language = 'python'").first()
    assert row.files == 3 and row.invalid >= 1
    assert validity.causes(checked).filter("first_cause IS NULL AND language = 'python'").count() == 1
    assert validity.check(df.limit(0)).count() == 0
