import pytest

from skein.llm import syntax
from skein.llm.grammars import Languages

L = Languages()
VALID = {
    "python": ["", "def f(a, *, b=1) -> int:\n    match a:\n        case [1, *_]:\n            return b\n", "﻿x = 1\n"],
    "java": [
        'package a.b;\nimport java.util.*;\n@Deprecated\npublic abstract class A<T extends Comparable<T>> extends B implements C<T>, D {\n  private static final int[] X = {1, 2, 3};\n  public <K> Map<String, List<K>> f(final T t, int... xs) throws E {\n    for (int i = 0; i < 3; i++) { if (i > 1) continue; else break; }\n    for (var x : xs) g((int) x, y -> y + 1, A::new);\n    try (var r = open()) { r.close(); } catch (E | F e) { throw new G("x", e); } finally { done(); }\n    int v = switch (t) { case 1, 2 -> 3; default -> { yield 4; } };\n    return a ? b : c instanceof D d ? d : null;\n  }\n}\nenum E { A(1) { void f() {} }, B; int x; }\nrecord P(int x, int y) {}\ninterface I { default void f() {} int g(); }\n',
    ],
    "c": [
        '#include <stdio.h>\n#define X(a) \\\n  (a)\ntypedef struct node { int v : 3; struct node *next; } node_t;\nstatic const unsigned char d[] = {0x1, 0x2, [3] = 4};\nenum e { A = 1, B };\nint (*fp)(int, char **);\nstatic inline int f(const char *s, size_t n) {\n  for (size_t i = 0; i < n; i++) { s[i] ? g(&s[i]) : (void)0; }\n  do { n--; } while (n);\n  switch (n) { case 1: break; default: goto end; }\nend:\n  return (int)sizeof(node_t) + "a" "b"[0];\n}\n',
    ],
    "go": [
        'package main\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\ntype S[T any] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\ntype I interface {\n\tF(int) (string, error)\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (r string, err error) {\n\tif v, ok := m["a"]; ok && v > 1 {\n\t\treturn fmt.Sprintf("%d", v), nil\n\t} else if x == nil {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tswitch t := x.(type) {\n\tcase int, string:\n\t\tbreak\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\tuse(v)\n\t}\n\ty := []map[string]int{{"a": 1}, {\n\t\t"b": 2,\n\t}}\n\tdefer close(ch)\n\treturn\n}\n',
    ],
    "rust": [
        "#![allow(dead_code)]\nuse std::{fmt, io::{self, Read as R}};\npub struct P<'a, T: Clone + 'a = u8> where T: Copy { pub x: &'a [T; 3], y: Option<Vec<Box<dyn Fn(i32) -> u8 + Send>>> }\npub enum E { A, B(u8, String), C { x: i32 } = 3 }\nimpl<'a, T> fmt::Display for P<'a, T> where T: Copy {\n    pub(crate) async fn f<F: FnOnce() -> u8>(&mut self, mut a: F, (b, _): (i32, u8)) -> Result<Self, Box<dyn std::error::Error>> {\n        let Some(x) = y else { return Err(E::A.into()); };\n        if let Some(E::B(n, ref s)) = v { println!(\"{} {:?}\", n, s); } else if a && b {} else {}\n        let c = |x: i32, y| -> i32 { x + y };\n        'outer: loop { while let Ok(z) = it.next()? { break 'outer; } }\n        let r = match q { 0 | 1..=5 if ok => S { a, b: 1, ..Default::default() }, E::C { x, .. } => { 1 } _ => unreachable!(), };\n        let v = vec.iter().map(|x| x.y as u64 >> 2).collect::<Vec<_>>();\n        Ok(&v[..2])\n    }\n}\nmacro_rules! m { ($x:expr) => { $x + }; }\nstatic mut X: u8 = b'a';\n",
    ],
    "javascript": [
        "import a, { b as c } from './x'\nexport default class A extends B {\n  static #p = 1\n  async *f({ a, b: [c] } = {}, ...rest) { for await (const x of y) yield x }\n  get x() { return this.#p ?? 1 }\n}\nexport const f = async (x) => { await x?.y?.[0]?.(1) }\nlet re = /a[/]b/g, t = `x ${a + `n ${b}`} y`\nif (a) b()\nelse if (c) { d() } else e\nlabel: for (let i = 0, n = 1; i < n; i++) continue label\nswitch (x) { case 1: case 2: y(); break; default: z() }\ntry { q() } catch { r() } finally {}\nvar o = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, ...f }\nfoo\n  .bar()\n  .baz(function () { return })\n!function(){}()\n",
        "const x = <div className=\"a\" {...p}>{list.map((i) => <b key={i}>{i}</b>)} text <br/></div>;\n",
    ],
    "typescript": [
        "import type { A } from 'a';\nexport interface I<T extends object = {}> extends J<T> {\n  readonly a?: Array<string> | null;\n  [k: string]: unknown;\n  f<U>(x: U, y?: number): Promise<void>;\n}\ntype F = (a: string, b?: number) => { x: number }[] | 'lit' | typeof y;\ntype M<T> = { readonly [K in keyof T]?: T[K] extends string ? K : never };\nabstract class C<T> extends D<T> implements I {\n  private readonly x: number = 1;\n  constructor(private a: string, public b?: number) { super(); }\n  abstract g(): void;\n  h<T>(this: C<T>, x: T): x is NonNullable<T> { return x! as unknown as T; }\n}\nenum E { A = 1, B }\ndeclare module 'x' { export function f(a: number): void; }\nexport function over(a: string): void;\nexport function over(a: any) { return new Map<string, number>(); }\nlet v: [number, string?] = [1] satisfies unknown[];\n",
    ],
}
BROKEN = {
    "python": ["def f(:\n  pass\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n", "x\0y"],
    "java": ["class A { int f() { return 1; }", "class A { int x = ; }", "class A { void f() { g(a,,b); } }", 'class A { String s = "a; }', "class A { void f() { int x = g((y); } }", "class A {\n<<<<<<< HEAD\nint x;\n}", "class A { int x = 1 }", "x y z"],
    "c": ["int f(void) { return 1;", "int f(void) { x = ; }", "int f(void) { g(a,,b); }", 'char *s = "abc;\n', "int f(int a { return 1; }", "import os\n"],
    "go": ["package a\nfunc f() {\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f( {\n}\n", "func f() {}\n", "package a\n\nfunc f() {\n\tx = “a”\n}\n", "package a\nclass A {}\n"],
    "rust": ["fn f() { let x = ; }", "fn f( -> u8 { 1 }", "fn f() { g(a b) }", "def f():\n    pass\n", "fn f() { x( }"],
    "javascript": ["const x = f((y);", "function f(a { return 1 }", "const s = 'abc;\n", "class A { const x = 1 }", "f(a,,b)", "let x: number = 1;", "interface A { b: string }", "x y z", "1: const x = 1;\n2: y()\n"],
    "typescript": ["const x: = 1;", "function f(a: ) {}", "interface A { b: string", "def f(self):\n  pass", "let x = ;"],
}


@pytest.mark.parametrize("name", VALID)
def test_valid_texts_fit(name):
    for text in VALID[name]:
        assert L.fits(name, text), text
        assert L.fits(name, text.replace("\n", "\r\n")), "line ends of another kind"


@pytest.mark.parametrize("name", BROKEN)
def test_broken_texts_do_not_fit(name):
    for text in BROKEN[name]:
        assert not L.fits(name, text), text


def test_memo_does_not_change_verdicts():
    for _ in range(2):
        for name in VALID:
            for a in VALID[name]:
                for b in BROKEN[name]:
                    assert L.fits(name, a) and not L.fits(name, b)


def test_files_are_checked_as_a_whole_and_foreign_text_is_named(spark):
    half = ("class A {\n  int f() {", "    return 1;\n  }\n}")
    rows = [
        ("r", "src/A.java", "1", half[0], 1, 2),
        ("r", "src/A.java", "2", half[1], 3, 5),
        ("r", "src/A.java", "2", half[1], 3, 5),
        ("r", " .\\Odd name.PY", "3", "x = 1\n", 1, 1),
        ("r", "b.py", "4", "package main\n\nfunc f() {\n\treturn\n}\n", 1, 5),
        (None, "c.rs", "5", "fn f( {", 1, 1),
        ("r", "d.md", "6", "anything (", 1, 1),
        ("r", "e.go", "7", None, 1, 1),
        ("r", None, "8", "x", 1, 1),
    ]
    df = spark.createDataFrame(rows, "repo string, relative_path string, id string, content string, start_line long, end_line long").selectExpr("*", "'x' as text", "1 as state")
    got = {r["relative_path"]: (r["state"], r["found"]) for r in syntax.check_files(df).collect()}
    assert got == {"src/A.java": ("valid", "java"), " .\\Odd name.PY": ("valid", "python"), "b.py": ("foreign", "go"), "c.rs": ("corrupt", None)}
    rates = {(r["repo"], r["language"]): r["invalid_rate"] for r in syntax.rates(syntax.check_files(df)).collect()}
    assert rates[("r", "python")] == 0.5 and rates[(None, "rust")] == 1.0
    assert syntax.check_files(df.limit(0)).collect() == []
