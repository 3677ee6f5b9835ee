"""Texts that a compiler accepts or refuses, one pair or more for each rule that was loose once."""

import pytest

from skein.llm.grammars import Languages

LANGUAGES = Languages()


def _java(body: str) -> str:
    return "class A {\n  void f() {\n    " + body + "\n  }\n}\n"


def _c(body: str) -> str:
    return "int f(int a) {\n  " + body + "\n}\n"


def _go(body: str) -> str:
    return "package main\n\nfunc f() {\n\t" + body + "\n}\n"


VALID = [
    ("java", _java("if (a) { b(); } else if (c) d(); else { e(); }")),
    ("java", _java("if (a) if (b) c(); else d(); else e();")),
    ("java", _java("while (a) if (b) c(); else d();")),
    ("java", _java("try { a(); } catch (E e) { b(); }")),
    ("java", _java("try { a(); } finally { b(); }")),
    ("java", _java("try (R r = open()) { a(); }")),
    ("java", _java("a = b + c; ++i; i--; new A(); x.y().z(); a[i] += 2; int q = a + b; new B() { void g() { } };")),
    ("java", "public sealed interface S permits A, B { }\nnon-sealed class C implements S { }\n"),
    ("java", "public static final class A { private static final int X = 1; }"),
    ("java", _java("switch (o) { case A a -> f(a); case P(int x, int y) when x > y -> g(); default -> { h(); } }")),
    ("java", _java("var r = switch (x) { case 1, 2 -> 3; default -> 4; };")),
    ("java", _java("do i++; while (i < 3);")),
    ("c", _c('asm volatile ("nop" ::: "memory");')),
    ("c", _c('__asm__ ("addl %1, %0" : "=r" (a) : "r" (b), "0" (a) : "cc"); return a;')),
    ("c", "int add(a, b)\n  int a;\n  long b, *c;\n{\n  return a + b;\n}\n"),
    ("c", "#ifdef WIDE\nint f(long a) {\n#else\nint f(int a) {\n#endif\n  return a;\n}\n"),
    ("c", _c("if (a) b(); else if (c) d(); else { e(); }")),
    ("c", _c("switch (a) { case 1: case 2: b(); break; default: ; }")),
    ("c", _c("for (;;) if (a) break; else continue;")),
    ("c", _c("do a--; while (a);")),
    ("go", _go("a, b := 1, 2\n\ta = b\n\tf()\n\t<-c\n\tc <- a\n\ta++\n\tx.y[1] = 3\n\tgo f()")),
    ("go", _go("if v, ok := m[k]; ok {\n\t} else if x {\n\t} else {\n\t}")),
    ("javascript", "if (a) { b() } else if (c) d()\nelse { e() }\n"),
    ("javascript", "try { a() } catch { b() }\ntry { a() } finally { b() }\n"),
    ("javascript", "const x = 1, { y, z } = w\nlet q\nfor (const k of v) f(k)\nfor (const k in v) f(k)\n"),
    ("javascript", "export default class { }\n"),
    ("javascript", "export default function () { }\nconst f = function () { }, g = class { }\n(function () { })()\n"),
    ("javascript", "do a()\nwhile (b)\n"),
    ("typescript", "declare const x: number\nconst y: string = 'a'\n"),
    ("rust", "fn f() -> i32 { match a { 1 => b(), _ => { } }.g(); if a { 1 } else { 2 } }"),
]
BROKEN = [
    ("java", _java("else { }")),
    ("java", _java("if (a) { } b(); else { }")),
    ("java", _java("try { }")),
    ("java", _java("a + b;")),
    ("java", _java("a;")),
    ("java", "class A { public public int x; }"),
    ("java", "class A { public private int x; }"),
    ("java", "class A { static final static int x = 1; }"),
    ("java", _java("if (a) { } else { } else { }")),
    ("c", _c("else { }")),
    ("c", _c("a = 1; else b();")),
    ("c", _c('asm volatile ("nop" ::: memory ();')),
    ("c", "#ifdef WIDE\nint f(long a) {\n#else\nint f(int a) {\n#endif\n  return a;\n"),
    ("go", _go("a + b")),
    ("go", _go("3 := x")),
    ("go", _go("a.b := x")),
    ("go", _go("a == b")),
    ("javascript", "else { }\n"),
    ("javascript", "try { a() }\nb()\n"),
    ("javascript", "const x;\n"),
    ("javascript", "class { }\n"),
    ("javascript", "function () { }\n"),
    ("javascript", "let { a };\n"),
    ("typescript", "const x;\n"),
    ("typescript", "else { }\n"),
    ("rust", "fn f() { let = 3; }"),
]


@pytest.mark.parametrize("language,text", VALID)
def test_valid(language, text):
    assert LANGUAGES.fits(language, text)


@pytest.mark.parametrize("language,text", BROKEN)
def test_broken(language, text):
    assert not LANGUAGES.fits(language, text)


@pytest.mark.parametrize("language,text", VALID)
@pytest.mark.parametrize("some", [10, 40, 90])
def test_an_opening_of_a_fitting_text_is_never_refused(language, text, some):
    grammar = LANGUAGES.grammar(language)
    if grammar.fits(text):
        assert grammar.may_fit(text, (some,))
