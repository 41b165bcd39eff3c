"""Problem 5: the derivative parser on snippets, against Python's own parser, and under damage."""

import ast
import glob
import random
import warnings

import pytest

from skein.llm.derivatives import Grammar
from skein.llm.grammars import LEXERS, check
from skein.llm.validity import check_files, invalid_rates

VALID = {
    "python": ["", "# only a comment", "x: int = (1,\n 2)\n", "def f(a, *, b=1, **k) -> int:\n    '''d'''\n    return [i for i in a if i]\n", "match x:\n    case [1, *r] if r:\n        pass\n    case {'a': _}:\n        pass\n", "async def f():\n    async with a as b, c:\n        await d\n", "lambda *a, b=1: a\n", "if a:\n\tpass\nelse:\n\tpass", "with (open(a) as b):\n    pass\n", "@d(1)\nclass A(B, k=1):\n    x = y = 1\n", "try:\n    pass\nexcept* E as e:\n    raise X from e\nfinally:\n    del a[0]\n", "print(f'{a!r:>{w}}', end='')\r\n", "\ufeffx = 1"],
    "javascript": ["a = b\nc = d", "const f = async ({a, b = 1}, ...r) => { await a?.b?.[0] ?? 2 }", "for (const [k, v] of m) if (k) continue\n", "x = /a[/]b/g.test(y) / 2", "class A extends B { #p = 1; static get x() { return `${a + `b`}` } async *g() {} }", "export default function () {}\nimport x, { y as z } from 'm'", "switch (a) { case 1: default: b() }", "label: while (1) { break label }", "var a = function* () { yield* b }, c = new D", "!function(n){n.t=0}(1)", "if (a) b\nelse c\n", "({ a, get b() { return 1 }, [c]: 2, ...d })"],
    "typescript": ["export class A<T extends B = C> implements D { private readonly x?: number; constructor(public a: string) { super() } @dec() m<U>(this: X, a?: U): a is string { return <any>1 > 0 } }".replace("<any>1 > 0", "1 > 0"), "type A = { [k in keyof B]?: B[k] } | ((a: number) => void) | [x: string, ...y: number[]]", "abstract class A { abstract f(): void }\ndeclare module 'x' { export const y: string }", "enum E { A = 1, B }\nnamespace N.M { let x = a as unknown as B<C<D>> }", "const x = f<string>('a')!.b satisfies C", "interface I extends J { (a: number): string; readonly b: string; new (x: I): J }", "import type { A } from './a'", "function f(a: string): asserts a is 'b';\nfunction f(a: any) {}"],
    "java": ["package a.b; import static x.Y.*; @A(b = {1, 2}) public final class C<T extends D & E> extends F<T[]> implements G { int[] a = {1, 2}, b; static { } C() throws X { this(1); } <U> U m(final U... u) { for (int i = 0, j = 1; i < j; i++) { a[i] = (int) b >>> 2; } for (var x : xs) try (R r = new R()) { } catch (A | B e) { } return x -> y::z; } }", "enum E { A(1) { void f() {} }, B; int x; }", "interface I { default void f() { } int X = 1; }", "record P(int x, @A String y) { P { } }", "class A { Object f(Object o) { return switch (o) { case String s when s.isEmpty() -> 1; case null, default -> { yield 2; } }; } }", "class A { Map<String, List<? super B>> m = new HashMap<>(); int x = a < b ? c : (d); }"],
    "csharp": ["using System; namespace A.B { public partial class C<T> : D, E where T : class, new() { [F(G = 1)] public int X { get; private set; } = 1; public C(int a) : base(a) { } event H I; int this[int i] => i; public static C operator +(C a, C b) => a; async Task<int> M(ref int a, out B b, params int[] c) { var (x, y) = f(out var z); await foreach (var i in s) { } return a switch { > 1 and < 3 => 2, _ => throw new E() }; } } }", "namespace A;\nrecord P(int X, int Y);\nenum E { A = 1, B }", "class A { void F() { var q = from x in y where x.Z > 1 orderby x.A descending select new { x.B }; lock (a) { } using var d = e; var s = $\"{a:x} {b}\" + @\"c\"\"d\"; int? n = a?.B ?? c![1..^2]; } }", "Console.WriteLine(1);", "class A { Dictionary<string, int> d = new Dictionary<string, int>(); delegate void D<T>(T t); }"],
    "go": ["package a\n\nimport (\n\t\"b\"\n\t_ \"c\"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn\n\t} else if a > b {\n\t}\n\tfor i := range xs {\n\t\tgo func() { c <- i }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t}\n\treturn a &^ b, nil\n}\n", "package a; var x = map[string][]int{\"a\": {1, 2}}", "package a\nconst (\n\tA = iota\n\tB\n)\ntype F func(int) <-chan int\ntype I interface {\n\tM(x int)\n\t~int | string\n}"],
    "rust": ["#![allow(x)]\nuse a::{b, c::*};\n#[derive(A)]\npub struct S<'a, T: B + 'a> where T: C { pub x: &'a T }\nimpl<T> D for S<'_, T> { const X: u8 = 1; fn f(&mut self, x: impl Fn(u8) -> u8) -> Result<Vec<T>, E> { let Some(y) = x else { return Ok(vec![1; 2]) }; match y { 1..=3 | 5 => a?, n @ 4 if n > 1 => { } _ => b.c::<D>(|x| x + 1), } for i in 0..n { if let Some(z) = w && z > 1 { break 'l; } } S { x, ..Default::default() } } }", "macro_rules! m { ($x:expr) => { $x + 1 }; }", "fn main() { println!(\"{}\", 'a' as u8); let r = r#\"a\"b\"#; let c = async move { x.await }; }", "pub enum E { A(u8, #[a] B), C { x: u8 }, D = 3 }\ntrait T { type X; fn f(); }\nmod m { pub(crate) static Y: &str = \"y\"; }\nextern \"C\" { fn z(); }"],
    "ruby": ["class A < B\n  attr_reader :x\n  def m(a, b = 1, *c, k:, **o, &d)\n    return 1 if a.nil?\n    x = a&.b || c[0]\n    y.each_with_index do |e, i|\n      puts \"#{e} x\"\n    end\n  rescue E, F => e\n    raise X, \"y\"\n  ensure\n    z\n  end\nend", "h = { a: 1, 'b' => 2, **c }\nf = ->(x) { x * 2 }\n", "case x\nwhen 1, 2 then a\nelse b\nend", "x = if a then b else c end\nunless y\n  z\nend\nwhile i < 3 do i += 1 end", "a = <<~T\n  any end text\nT\n%w[a b].map(&:to_s)\n", "begin\n  a\nend while b\nmodule M; end\nfoo.bar :a, b: 1\nx = a ? b : c\n", "return 0 if q.empty?\nlog.info(\"x\") unless y\nz = x =~ /a\\/b/\n"],
}
INVALID = {
    "python": ["def f(:\n  pass", "if a:\npass", "x = (1", "class A\n    pass", "x = “a”", "<<<<<<< ours\nx = 1", "  x = 1", "try:\n    a\n", "import java.util.List;\npublic class A { }", "print('a)", "a b", "if a:\n    b\n  c\n"],
    "javascript": ["function f( {", "const x = [1, 2", "let a: number = 1", "class A { x: 1 }", "<!DOCTYPE html>", "{ \"a\": 1 }", "if (a { }", "}", "<<<<<<< HEAD\n", "var x = 'a", "a b"],
    "typescript": ["export class A { m( { }", "let x: = 1", "interface A { b: }", "using System;", "import { a from 'b'", "function f() { return"],
    "java": ["class A { void f() { int x = 1 } }", "class A { void f() { }", "using System; class A { }", "class A { void f( { } }", "import a.b\nclass A { }", "class { }", "class A { String s = \"a; }"],
    "csharp": ["class A { void F() { x = 1 } }", "class A { int X { get; set }", "import java.util.List;", "namespace A { class B { }", "class A { void F() { f(“x”); } }"],
    "go": ["func f() {}", "package a\nfunc f( {\n}", "package a\nfunc f() {\n\tx := \n}", "package a\nclass A { }", "package a.b;", "package a\nfunc f() {", "package a\nimport \"b"],
    "rust": ["fn f( { }", "fn f() { let x = ; }", "fn f() {", "struct S { x u8 }", "class A { }", "fn f() -> { }", "package main"],
    "ruby": ["def f\n  x\n", "class A\n  def f\n  end\n", "end", "x = [1, 2\n", "if a\n", "foo(1", "puts “a”", "def f(a:\nend", "x = {"],
}


@pytest.mark.parametrize("language", sorted(LEXERS))
def test_valid_texts_pass(language):
    for text in VALID[language]:
        assert check(text, language) is None, (language, text, check(text, language))
        assert check(text.replace("\n", "\r\n"), language) is None


@pytest.mark.parametrize("language", sorted(LEXERS))
def test_invalid_texts_fail(language):
    for text in INVALID[language]:
        assert check(text, language) is not None, (language, text)


def test_the_failing_token_and_the_early_end_are_told():
    assert check("x = (1", "python")[1] in ("end", "NEWLINE")
    assert check("class A { void f() { }", "java") == (9, "end")
    assert check("class A { void f() { int x = 1 } }", "java") == (12, "}")


def test_damage_is_found_as_python_finds_it():
    warnings.simplefilter("ignore")
    duckdb = pytest.importorskip("duckdb")
    if not glob.glob("/root/testdata/sf0.01/source_files.parquet"):
        pytest.skip("no test tables here")
    texts = [r[0] for r in duckdb.sql("SELECT content FROM '/root/testdata/sf0.01/source_files.parquet' s JOIN '/root/testdata/sf0.01/files.parquet' f ON f.id = s.file_id WHERE language = 'python'").fetchall()]
    rnd = random.Random(1)
    cases = list(texts)
    for t in texts:
        if len(t) > 200:
            i = rnd.randrange(len(t))
            cases += [t[:i], t[:i] + t[i + 1 :], t[:i] + rnd.choice("([{)]}:=,'\" \n") + t[i:]]
    wrong = 0
    for t in cases:
        try:
            ast.parse(t.lstrip("\ufeff"))
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        wrong += ok != (check(t, "python") is None)
    # left are phases after parsing (assignment to calls, names twice) and escapes inside strings
    assert wrong <= 0.02 * len(cases), (wrong, len(cases))


def test_memo_may_be_forgotten():
    g = Grammar("file = 'a' file 'b' | 'c' ;", max_nodes=3)
    for text, ok in (("aacbb", True), ("aacb", False), ("c", True)):
        s = g.fresh()
        for t in text:
            s = g.derive(s, t)
        assert s.null == ok


def test_operator_on_odd_rows(spark):
    files = spark.createDataFrame([(1, "p", "python", "x"), (2, "p", "python", "x"), (3, "p", "css", "x"), (4, None, None, "x"), (5, "p", "python", "x"), (5, "p", "python", "x")], "id long, project string, language string, content string")
    src = spark.createDataFrame([(1, "x = ("), (2, None), (3, "{{{"), (4, "?"), (5, "x = 1\n" * 50_000)], "file_id long, content string")
    got = sorted((r.file_id, r.valid) for r in check_files(files, src).collect())
    assert got == [(1, False), (2, True), (3, None), (4, None), (5, True), (5, True)] or sorted(got, key=str) == sorted([(1, False), (2, True), (3, None), (4, None), (5, True), (5, True)], key=str)
    assert [(r.files, r.invalid) for r in invalid_rates(check_files(files, src)).collect()] == [(4, 1)]
    assert check_files(files.limit(0), src.limit(0)).count() == 0


def test_what_the_stack_does_not_hold_is_not_judged(spark, monkeypatch):
    from skein.llm import validity

    def deep(text, language):
        raise RecursionError

    monkeypatch.setattr(validity, "check", deep)
    got = validity._judge({"file_id": [1], "project": ["p"], "language": ["python"], "content": ["(" * 9]})
    assert got["valid"] == [None] and got["token"] == ["depth"]
